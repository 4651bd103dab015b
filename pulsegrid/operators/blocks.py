"""Blocks of time: what a window over a whole path would need, from windows over one block and one row for each block.

A path of any length is spread over its blocks.  What the earlier blocks of a path hand on (counts, or their last event)
is found over the block table, which has one row for thousands of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

col = F.col
EVENTS_PER_BLOCK = 4_096


def extent(events: DataFrame) -> tuple[int, float]:
    """(events, time) of the longest path and of the path that lasts longest; one aggregate."""
    per = events.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"))
    got = per.agg(F.max("n").alias("n"), F.max("span").alias("span")).first()
    return int(got["n"] or 0), float(got["span"] or 0.0)


def width_of(n: int, span: float, per_block: int = EVENTS_PER_BLOCK) -> float:
    return span / max(1, -(-n // per_block)) if n and span else 1.0


def block_width(events: DataFrame, per_block: int = EVENTS_PER_BLOCK) -> float:
    """A width of time for which the longest path has about ``per_block`` events in a block."""
    return width_of(*extent(events), per_block)


def with_block(rows: DataFrame, width: float, t: str = "t") -> DataFrame:
    return rows.withColumn("block", F.floor(col(t) / F.lit(width)))


def counts_before(rows: DataFrame, ones: dict[str, Column], width: float, inclusive: bool = False) -> DataFrame:
    """Adds for each name the sum of its whole-numbered column, a 0/1 or a count, over the rows of the path that are earlier (or at the same time)."""
    names = list(ones)
    rows = with_block(rows, width).withColumns({f"__one_{c}": x.cast("long") for c, x in ones.items()})
    up_to = Window.partitionBy("path_id", "block").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy("path_id", "block", "t")
    here = {c: F.sum(f"__one_{c}").over(up_to) - (F.lit(0) if inclusive else F.sum(f"__one_{c}").over(tied)) for c in names}
    totals = rows.groupBy("path_id", "block").agg(*[F.sum(f"__one_{c}").alias(f"__all_{c}") for c in names])
    back = Window.partitionBy("path_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("path_id", "block", *[F.coalesce(F.sum(f"__all_{c}").over(back), F.lit(0)).alias(f"__from_{c}") for c in names])
    out = rows.withColumns(here).join(carried, ["path_id", "block"])
    return out.withColumns({c: col(c) + col(f"__from_{c}") for c in names}).drop("block", *[f"__{k}_{c}" for k in ("one", "from") for c in names])


def ranked(events: DataFrame, width: float) -> DataFrame:
    """Adds ``m``, the number of the event within its path and dimension in the order of t and event_id."""
    rows = with_block(events, width)
    here = F.row_number().over(Window.partitionBy("path_id", "dim", "block").orderBy("t", "event_id"))
    totals = rows.groupBy("path_id", "dim", "block").agg(F.count(F.lit(1)).alias("__n"))
    back = Window.partitionBy("path_id", "dim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("path_id", "dim", "block", F.coalesce(F.sum("__n").over(back), F.lit(0)).alias("__from"))
    return rows.withColumn("m", here).join(carried, ["path_id", "dim", "block"]).withColumn("m", (col("m") + col("__from") - 1).cast("long")).drop("block", "__from")


def kappa(events: DataFrame, dims: int, width: float | None = None) -> DataFrame:
    """(path_id, i, m, j, kappa): the index of the last type-j event strictly before event m of type i, or -1."""
    width = width or block_width(events)
    out = counts_before(ranked(events, width), {f"k{j}": col("dim") == j for j in range(dims)}, width)
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), (col(f"k{j}") - 1).alias("kappa")) for j in range(dims)])).alias("x")
    return out.select("path_id", col("dim").alias("i"), "m", each).select("path_id", "i", "m", "x.j", "x.kappa")


def kappa_totals(events: DataFrame, dims: int, width: float | None = None) -> DataFrame:
    """(path_id, i, n, kappa_0, kappa_1 ...): the number of events of type i, and ``kappa`` summed over them for each type.

    Events of a path and type at one time have equal indices, so they are one row with their number.
    """
    grouped = events.groupBy("path_id", "dim", "t").agg(F.count(F.lit(1)).alias("n"))
    width = width or block_width(grouped)
    out = counts_before(grouped, {f"k{j}": F.when(col("dim") == j, col("n")).otherwise(0) for j in range(dims)}, width)
    return out.groupBy("path_id", col("dim").alias("i")).agg(F.sum("n").alias("n"), *[F.sum(col("n") * (col(f"k{j}") - 1)).alias(f"kappa_{j}") for j in range(dims)])


def counting_process(queries: DataFrame, events: DataFrame, dims: int, width: float | None = None) -> DataFrame:
    """(query_id, path_id, t, n_0, n_1 ...): how many events of each dimension stand at or before t."""
    width = width or block_width(events)
    rows = events.select("path_id", "t", "dim", F.lit(None).cast("long").alias("query_id")).unionByName(queries.select("path_id", "t", F.lit(None).cast("int").alias("dim"), "query_id"))
    out = counts_before(rows, {f"n_{j}": F.coalesce(col("dim") == j, F.lit(False)) for j in range(dims)}, width, inclusive=True)
    return out.where("query_id is not null").select("query_id", "path_id", "t", *[f"n_{j}" for j in range(dims)])


def look_up(queries: DataFrame, events: DataFrame, forward: bool, inclusive: bool, width: float | None = None) -> DataFrame:
    """For each query (query_id, path_id, t) the next or the previous event of its path, from the union of both sides by blocks."""
    width = width or block_width(events)
    found = F.struct(col("t").alias("t"), col("dim").alias("dim"), col("event_id").alias("event_id"), col("mark").alias("mark"))
    # at equal times an event stands on the side where it may be found only if it counts
    event_first = inclusive != forward
    side = lambda is_event: F.lit(0 if is_event == event_first else 1)
    rows = events.select("path_id", "t", side(True).alias("side"), found.alias("e"), F.lit(None).cast("long").alias("query_id"))
    rows = with_block(rows.unionByName(queries.select("path_id", "t", side(False).alias("side"), F.lit(None).cast(rows.schema["e"].dataType).alias("e"), "query_id")), width)
    base = Window.partitionBy("path_id", "block").orderBy("t", "side", col("e.dim").asc() if forward else col("e.dim").desc(), "query_id")
    over = Window.partitionBy("path_id").orderBy("block")
    if forward:
        here = F.first("e", ignorenulls=True).over(base.rowsBetween(1, Window.unboundedFollowing))
        edge = F.min(F.when(col("e").isNotNull(), F.struct(col("t").alias("at"), col("e.dim").alias("dim"), "e")))
        carry = F.first("edge", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    else:
        here = F.last("e", ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, -1))
        edge = F.max(F.when(col("e").isNotNull(), F.struct(col("t").alias("at"), (-col("e.dim")).alias("dim"), "e")))
        carry = F.last("edge", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("path_id", "block").agg(edge.alias("edge")).select("path_id", "block", carry.alias("carried"))
    out = rows.withColumn("hit", here).where("query_id is not null").join(blocks, ["path_id", "block"]).withColumn("hit", F.coalesce("hit", "carried.e"))
    return out.select("query_id", "path_id", "t", col("hit.t").alias("t_event"), col("hit.dim").alias("dim"), col("hit.mark").alias("mark"))
