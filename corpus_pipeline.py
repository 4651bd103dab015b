"""The training corpus, from documents to shards.

Each stage takes what the one before has written and returns a DataFrame: quality rules, near
duplicates, benchmark decontamination, mixing to source weights, sharding.  All but the last return
the columns of documents; the last adds ``shard`` and ``slot``.  As a stage begins, the tables that the stage before it made for itself have no reader left, as its result
has been written, and are deleted; so the disk holds the needs of one stage and not of all.

Defined results: each stage's for null, empty, very long, repeated and missing rows; see its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import delete_tables, table, tables_noted, written
from pulsegrid.llm.decontam import drop_contaminated
from pulsegrid.llm.minhash import drop_near_duplicates
from pulsegrid.llm.mixing import mix
from pulsegrid.llm.quality import keep_good
from pulsegrid.llm.sharding import shard_rows

#: Tables of the stage that ran last.
_left: list[str] = []


def _stage(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """What ``work`` returns, once the tables of the stage before are deleted; its own are noted."""
    delete_tables(spark, _left)
    with tables_noted() as own:
        out = work()
    _left.extend(own)
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: keep_good(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: drop_near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: drop_contaminated(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: mix(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: shard_rows(docs))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned rules, sketches and seeded shuffles cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; its table is all that stays on the disk."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with tables_noted() as now:
            docs = written(out)
        delete_tables(spark, before)
        before = list(now)
    delete_tables(spark, _left)
    return docs
