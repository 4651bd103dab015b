"""Mixing sources to target weights: a time-varying curriculum over integrated weight schedules.

Source s has the weight w_s * (1 + a_s * (2 t - 1)) at time t of training, from 0 to 1.  Its integral
gives the cumulative token demand T_s * (t + a_s * (t^2 - t)), so that T_s is the source's target;
targets share all tokens by weight, stop at ``max_repeats`` times the source's size, and the
excess goes to the other sources.  A source's documents stand in a seeded hash order; the
document whose tokens begin at c is due when the demand reaches c, and inverting the demand
gives its position.  Where a target exceeds its source, the order is passed again.
``curriculum`` returns the documents with what is taken of each, range-sorted by position.

Running token sums have two levels: sums over hash buckets of each source, then a window within
one bucket, so that a source with a third of all rows is spread over many tasks.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source, the
last; repeated rows are separate documents; ties in the order are between equal rows only; an empty
table gives an empty result; very long texts are taken whole; extra columns are kept, but for those named as the results or beginning with ``__mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, small_or_plain, space_words, table

WEIGHTS = (1, 2, 3)
SLOPES = (0.5, 0.0, -0.5)
MAX_REPEATS = 3
HASH_DIGITS = 6
ROWS_PER_BUCKET = 20_000
MAX_BROADCAST_ROWS = 200_000


def word_size(text: Column) -> Column:
    return F.size(space_words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat over the sources by code point, null last.

    The sources are taken by rising cap per weight; those before the first that stays under its
    cap at the weight level of the rest are capped, which is where resharing ends.
    """
    col, lit = F.col, lambda xs: F.array(*[F.lit(x) for x in xs])
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("nth", nth).withColumn("w", F.element_at(lit(weights), col("nth") % len(weights) + 1).cast("double"))
    s = s.withColumn("slope", F.element_at(lit(slopes), col("nth") % len(slopes) + 1).cast("double"))
    s = s.withColumn("cap", (max_repeats * col("source_size")).cast("double"))
    everything = Window.partitionBy()
    rising = Window.orderBy(col("cap") / col("w"), "nth")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum(col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    fits = col("left") * col("w") <= col("cap") * col("w_left")
    s = s.withColumn("free", F.max(fits).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.first(F.when(col("free"), col(c)), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("target", F.when(col("free"), F.least(first("left") * col("w") / first("w_left"), col("cap"))).otherwise(col("cap")))
    return s.select("source", "source_size", "target", "slope")


def position(share: Column, slope: Column) -> Column:
    """The time at which a source's demand has reached ``share`` of its target: t + a (t^2 - t) = share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def curriculum(docs: DataFrame, *, size: str, doc_id: str = "doc_id", source: str = "source", tie: str | None = None, seed: int = 17, whole: bool = False, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds source_size, target, taken, passes (how often a part of it is taken) and positions (of each pass).

    ``size`` names a long column.  With ``whole`` the document at the end of a source's last pass is
    taken wholly or not at all, else as many of its words as are still due.  ``tie`` names a column that
    orders rows of equal ids and sizes.  The names added, and
    those that begin with ``__mix``, are replaced if ``docs`` has them.
    """
    col = F.col
    own = ("source_size", "target", "taken", "passes", "positions")
    docs = docs.select(*[col(f"`{c}`") for c in docs.columns if c.lower() not in own and not c.lower().startswith("__mix")])
    n, s = col(f"`{size}`"), col(f"`{source}`")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col(f"`{doc_id}`").cast("string"), F.lit(""))))
    buckets = max(1, min(16**HASH_DIGITS, -(-docs.count() // ROWS_PER_BUCKET)))
    rows = docs.withColumns({"__mix_h": order})
    rows = rows.withColumn("__mix_b", F.floor(F.conv(F.substring("__mix_h", 1, HASH_DIGITS), 16, 10).cast("long") * buckets / 16**HASH_DIGITS).cast("int"))
    sums = cut_lineage(rows.groupBy(s.alias("__mix_s"), "__mix_b").agg(F.sum(n).alias("__mix_n"), F.count(F.lit(1)).alias("__mix_rows")))
    count = sums.count()  # at most sources x buckets rows
    targets = source_targets(sums.groupBy(col("__mix_s").alias("source")).agg(F.sum("__mix_n").alias("source_size")), max_repeats=max_repeats)
    start = F.coalesce(F.sum("__mix_n").over(Window.partitionBy("__mix_s").orderBy("__mix_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = sums.select("__mix_s", "__mix_b", start.alias("__mix_start")).join(targets, col("__mix_s").eqNullSafe(col("source"))).drop("source")
    known = known.select(col("__mix_s").alias("__mix_s2"), col("__mix_b").alias("__mix_b2"), "__mix_start", "source_size", "target", "slope")
    inner = Window.partitionBy(s, "__mix_b").orderBy("__mix_h", n, *[col(f"`{c}`") for c in (tie,) if c])
    rows = rows.withColumn("__mix_c", F.sum(n).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - n)
    rows = rows.join(small_or_plain(known, count, MAX_BROADCAST_ROWS), s.eqNullSafe(col("__mix_s2")) & (col("__mix_b") == col("__mix_b2")))
    rows = rows.withColumn("__mix_c", col("__mix_c") + col("__mix_start"))
    full = F.when(col("source_size") > 0, F.floor(col("target") / col("source_size"))).otherwise(0)
    rows = rows.withColumn("__mix_full", full.cast("long"))
    due = F.floor(col("target")) - col("__mix_full") * col("source_size")
    part = F.least(F.greatest(due - col("__mix_c"), F.lit(0)), n)
    if whole:
        part = F.when(2 * part >= n, n).otherwise(F.lit(0))
    rows = rows.withColumn("__mix_part", F.when(n > 0, part).otherwise(0).cast("long"))
    rows = rows.withColumn("taken", (col("__mix_full") * n + col("__mix_part")).cast("long"))
    rows = rows.withColumn("passes", F.when(n > 0, col("__mix_full") + (col("__mix_part") > 0).cast("long")).otherwise(0).cast("int"))
    share = lambda k: F.least((k * col("source_size") + col("__mix_c")) / col("target"), F.lit(1.0))
    at = F.transform(F.sequence(F.lit(0), F.greatest(col("passes") - 1, F.lit(0))), lambda k: position(share(k), col("slope")))
    rows = rows.withColumn("positions", F.when(col("passes") > 0, at).otherwise(F.array().cast("array<double>")))
    return rows.drop("__mix_h", "__mix_b", "__mix_c", "__mix_s2", "__mix_b2", "__mix_start", "slope", "__mix_full", "__mix_part")


def by_position(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Range-sorted: partition k + 1 begins where partition k ends."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The training order: whole documents, as often as they are taken, with the columns of ``docs``."""
    t = F.col(f"`{text}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_size(t).alias("size"), F.xxhash64(t).alias("tie"))
    taken = curriculum(packed, size="size", tie="tie", whole=True, **options)
    return by_position(taken.select("doc", "tie", F.explode("positions").alias("position")), "position", "tie").select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_size(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    rows = curriculum(docs, size="size", tie="tie").withColumn("first_position", F.get("positions", F.lit(0)))
    rows = by_position(rows, F.col("first_position").asc_nulls_last(), "doc_id")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "passes")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
w AS (SELECT *, CAST(nth % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM n),
b AS (
  SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
  FROM w
), f AS (SELECT *, max(CAST(rest * w <= cap * w_rest AS INT)) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free FROM b),
t AS (
  SELECT source, source_size, CASE WHEN free = 1 THEN least(
      (SELECT arg_min(rest, cap / w) FROM f WHERE free = 1) * w / (SELECT arg_min(w_rest, cap / w) FROM f WHERE free = 1), cap) ELSE cap END AS target
  FROM f
), c AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS c,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (SELECT *, CASE WHEN size > 0 THEN least(greatest(floor(target) - whole * source_size - c, 0), size) ELSE 0 END AS part FROM c)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN whole + CAST(part > 0 AS INT) ELSE 0 END AS INT) AS passes
FROM p
"""
