"""Sharding: a two-pass external shuffle into shards with equal row counts.

Pass one scatters the rows uniformly, by a seeded hash of the row's number, into as many buckets as
make a bucket fit in memory.  Pass two shuffles each bucket by Fisher-Yates with a seed of its
own and writes it.  Buckets one after another are then one random permutation of all rows; the
shard and the slot follow from a row's place in it, and the counts of shards differ by one at most.

The hash takes the row's number, not its content, so copies of a row, or of a key, do not meet in
one bucket.  The only table that is ordered as a whole has a row for each bucket.

Defined results: null columns and texts are carried along; repeated rows are separate rows;
ties cannot occur; an empty table gives an empty result; extra columns are kept, and columns named
shard or slot or beginning with ``__shuffle`` are replaced.  The same files read the same way give the same shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import small_or_plain, table, written

SHARDS = 24
BUCKET_BYTES = 16 << 20
#: For small tables; the bytes alone decide, so that the shards do not depend on the cluster.
LEAST_BUCKETS = 24
MAX_BROADCAST_BUCKETS = 200_000


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def scatter(docs: DataFrame, *, text: str = "text", seed: int = 23, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Adds the row's number and its bucket; the bucket count."""
    total = docs.agg(F.sum(row_bytes(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot") and not c.lower().startswith("__shuffle")]
    rows = docs.select(*kept).withColumn("__shuffle_row", F.monotonically_increasing_id())  # used in one pass only
    return rows.withColumn("__shuffle_bucket", F.pmod(F.xxhash64(F.lit(seed), "__shuffle_row"), F.lit(buckets))), buckets


def external_shuffle(docs: DataFrame, *, text: str = "text", seed: int = 23, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows with ``__shuffle_bucket`` and ``__shuffle_at``, a place in it, as a written table."""
    rows, _ = scatter(docs, text=text, seed=seed, bucket_bytes=bucket_bytes)
    schema = T.StructType([f for f in rows.schema if f.name != "__shuffle_row"]).add("__shuffle_at", "long")

    def fisher_yates(key: tuple, bucket: pa.Table) -> pa.Table:
        by_row = np.argsort(bucket.column("__shuffle_row").to_numpy(), kind="stable")
        order = by_row[np.random.default_rng([seed, key[0].as_py()]).permutation(len(by_row))]
        out = bucket.drop_columns(["__shuffle_row"]).take(pa.array(order))
        return out.append_column("__shuffle_at", pa.array(np.arange(len(order))))

    return written(rows.groupBy("__shuffle_bucket").applyInArrow(fisher_yates, schema))


def shard_rows(docs: DataFrame, *, shards: int = SHARDS, text: str = "text", seed: int = 23, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds ``shard`` and ``slot`` to the shuffled rows."""
    col = F.col
    rows = external_shuffle(docs, text=text, seed=seed, bucket_bytes=bucket_bytes)
    counts = rows.groupBy("__shuffle_bucket").agg(F.count(F.lit(1)).alias("__shuffle_n"))
    before = Window.orderBy("__shuffle_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__shuffle_bucket", F.coalesce(F.sum("__shuffle_n").over(before), F.lit(0)).alias("__shuffle_start"), F.sum("__shuffle_n").over(Window.partitionBy()).alias("__shuffle_all"))
    rows = rows.join(small_or_plain(starts, counts.count(), MAX_BROADCAST_BUCKETS), "__shuffle_bucket")
    rows = rows.withColumn("__shuffle_at", col("__shuffle_start") + col("__shuffle_at"))
    rows = rows.withColumn("shard", F.expr(f"int((__shuffle_at * {shards}) div __shuffle_all)"))
    rows = rows.withColumn("slot", F.expr(f"__shuffle_at - (shard * __shuffle_all + {shards - 1}) div {shards}"))
    return rows.drop(*[c for c in rows.columns if c.startswith("__shuffle")])


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder for each shard, sorted by slot."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return rows.select("doc_id", row_bytes(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
