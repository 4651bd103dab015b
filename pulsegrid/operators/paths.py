"""Event paths as DataFrames (path_id, dim, t, mark): ranks, surgery, look-ups, histograms and rates.

Everything is keyed by ``path_id``; ties in t are never predecessors of each other.  An order within
a path and dimension is by t, then ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import blocks

col = F.col
ORIGIN = "timestamp_ntz'2024-01-01 00:00:00'"


def hours(ts: str) -> Column:
    """Hours from the fixed origin, as a double."""
    return F.expr(f"timestampdiff(MICROSECOND, {ORIGIN}, {ts}) / 3.6e9D")


def event_frame(events: DataFrame, *, path: str, dim: Column, t: Column, mark: Column, event_id: str) -> DataFrame:
    """The canonical columns (path_id, event_id, dim, t, mark)."""
    return events.select(col(path).alias("path_id"), col(event_id).alias("event_id"), dim.cast("int").alias("dim"), t.alias("t"), mark.alias("mark"))


def ranked(events: DataFrame) -> DataFrame:
    """Adds ``m``, the number of the event within its path and dimension, from 0."""
    return events.withColumn("m", F.row_number().over(Window.partitionBy("path_id", "dim").orderBy("t", "event_id")).cast("long") - 1)


def counts_and_rates(events: DataFrame, horizon: float) -> DataFrame:
    """(path_id, dim, n, eta)."""
    return events.groupBy("path_id", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("eta", col("n") / F.lit(horizon))


def inter_arrivals(events: DataFrame) -> DataFrame:
    """(path_id, dim, m, gap) of all but the first event of a dimension."""
    w = Window.partitionBy("path_id", "dim").orderBy("t", "event_id")
    return ranked(events).withColumn("gap", col("t") - F.lag("t").over(w)).where("gap is not null").select("path_id", "dim", "m", "gap")


def times_to_end(events: DataFrame, horizon: float) -> DataFrame:
    return events.withColumn("t_to_end", F.lit(horizon) - col("t"))


def truncate(events: DataFrame, horizon: float) -> DataFrame:
    """Events strictly before the horizon."""
    return events.where(col("t") < horizon)


def censor(events: DataFrame, removed: DataFrame) -> DataFrame:
    """Without the events (path_id, dim, m) of ``removed``; what stays is ranked anew."""
    left = ranked(events).join(removed.select("path_id", "dim", "m"), ["path_id", "dim", "m"], "left_anti")
    return ranked(left.drop("m"))


def sorted_paths(events: DataFrame, order: str = "event_id", strict: bool = False) -> DataFrame:
    """(path_id, dim, sorted): whether t rises along ``order``."""
    step = col("t") - F.lag("t").over(Window.partitionBy("path_id", "dim").orderBy(order))
    steps = events.select("path_id", "dim", step.alias("step"))
    ok = F.min("step") > 0 if strict else F.min("step") >= 0
    return steps.groupBy("path_id", "dim").agg(F.coalesce(ok, F.lit(True)).alias("sorted"))


def kappa(events: DataFrame, dims: int) -> DataFrame:
    """(path_id, i, m, j, kappa): the index of the last type-j event strictly before event m of type i, or -1; by blocks of time."""
    return blocks.kappa(events, dims)


def kappa_totals(events: DataFrame, dims: int) -> DataFrame:
    """(path_id, i, n, kappa_0, kappa_1 ...): sums of ``kappa`` over the events of each type, from counts at distinct times."""
    return blocks.kappa_totals(events, dims)


def lag_sizes(kappas: DataFrame) -> DataFrame:
    """(path_id, i, j, h, size): how many type-i events have at least h type-j predecessors, h from 1."""
    per = kappas.where("kappa >= 0").groupBy("path_id", "i", "j", (col("kappa") + 1).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    at_least = F.sum("n").over(Window.partitionBy("path_id", "i", "j").orderBy(col("h").desc()))
    return per.select("path_id", "i", "j", "h", at_least.alias("size"))


def varpi(kappas: DataFrame) -> DataFrame:
    """(path_id, i, j, h, first): the first type-i event with at least h type-j predecessors."""
    per = kappas.where("kappa >= 0").groupBy("path_id", "i", "j", (col("kappa") + 1).alias("h")).agg(F.min("m").alias("m"))
    least = F.min("m").over(Window.partitionBy("path_id", "i", "j").orderBy(col("h").desc()))
    return per.select("path_id", "i", "j", "h", least.alias("first"))


def next_event(queries: DataFrame, events: DataFrame, inclusive: bool = False) -> DataFrame:
    """For each query (query_id, path_id, t) the first event after t, or at t if ``inclusive``."""
    return blocks.look_up(queries, events, True, inclusive)


def previous_event(queries: DataFrame, events: DataFrame, inclusive: bool = False) -> DataFrame:
    """For each query the latest event before t, or at t if ``inclusive``."""
    return blocks.look_up(queries, events, False, inclusive)


def counting_process(queries: DataFrame, events: DataFrame, dims: int) -> DataFrame:
    """(query_id, path_id, t, n_0, n_1 ...): how many events of each dimension stand at or before t; by blocks of time."""
    return blocks.counting_process(queries, events, dims)


def _bin_of(period: float, bins: int) -> Column:
    return F.when(col("t") == bins * period, bins - 1).otherwise(F.floor(col("t") / period)).cast("long")


def histogram(events: DataFrame, period: float, bins: int) -> DataFrame:
    """(path_id, dim, bin, n) over [0, bins * period], every bin of every path and dimension; the last bin holds its right end."""
    at = _bin_of(period, bins)
    counted = events.where((col("t") >= 0) & (col("t") <= bins * period)).groupBy("path_id", "dim", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = events.select("path_id", "dim").distinct().select("path_id", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counted, ["path_id", "dim", "bin"], "left").select("path_id", "dim", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def empirical_intensity(events: DataFrame, period: float, bins: int) -> DataFrame:
    return histogram(events, period, bins).select("path_id", "dim", "bin", (col("n") / F.lit(period)).alias("intensity"))


def empirical_covariance(events: DataFrame, period: float, bins: int, max_lag: int) -> DataFrame:
    """(path_id, i, j, lag, covariance) of counts n_j(s), n_i(s + lag), over the bins that both have.

    A path's histograms meet in one row, an array of its bins for each dimension, so nothing but the counts is shuffled.
    """
    at = F.when((col("t") >= 0) & (col("t") <= bins * period), _bin_of(period, bins))
    counted = events.groupBy("path_id", "dim", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    held = counted.groupBy("path_id", "dim").agg(F.map_from_entries(F.collect_list(F.when(col("bin").isNotNull(), F.struct("bin", "n")))).alias("held"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda b: F.coalesce(col("held")[b], F.lit(0).cast("long")))
    lags = range(min(max_lag, bins - 1) + 1)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    part = lambda lag, late: F.slice("n", lag + 1 if late else 1, bins - lag)
    sides = held.select("path_id", "dim", dense.alias("n")).select("path_id", "dim", "n", *[F.array(*[total(part(lag, late)) for lag in lags]).alias(name) for name, late in (("late", True), ("early", False))])
    whole = sides.groupBy("path_id").agg(F.collect_list(F.struct("dim", "n", "late", "early")).alias("all"))
    both = whole.select("path_id", F.explode("all").alias("x"), "all").select("path_id", "x", F.explode("all").alias("y"))

    def covariance(lag: int) -> Column:
        product = total(F.zip_with(F.slice("x.n", lag + 1, bins - lag), F.slice("y.n", 1, bins - lag), lambda a, b: a * b))
        return product / (bins - lag) - col("x.late")[lag] / (bins - lag) * (col("y.early")[lag] / (bins - lag))

    each = F.array(*[F.struct(F.lit(lag).alias("lag"), (covariance(lag) / period).alias("covariance")) for lag in lags])
    return both.select("path_id", col("x.dim").alias("i"), col("y.dim").alias("j"), F.inline(each))


def interval_rates(events: DataFrame, bounds: list[float]) -> DataFrame:
    """(dim, piece, rate): events per unit of time in [bounds[k], bounds[k + 1]), over all paths; also the maximum likelihood piecewise rate."""
    pieces = list(zip(bounds, bounds[1:]))
    which = F.lit(None).cast("int")
    for k, (a, b) in enumerate(pieces):
        which = F.when((col("t") >= a) & (col("t") < b), k).otherwise(which)
    widths = F.array(*[F.lit(float(b - a)) for a, b in pieces])
    counted = events.withColumn("piece", which).where("piece is not null").groupBy("dim", "piece").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("dim", "piece", (col("n") / F.get(widths, col("piece"))).alias("rate"))


def category_shares(events: DataFrame, category: str = "dim") -> DataFrame:
    """(category, share) of all events."""
    n = events.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return n.select(category, (col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def relaxation_times(lineage: DataFrame) -> DataFrame:
    """(root_id, relaxation): the time from a source event to its last descendant, 0 without any."""
    return lineage.groupBy("root_id").agg((F.max("t") - F.min(F.when(col("generation") == 0, col("t")))).alias("relaxation"))


def grid(low: float, high: float, n: int, log: bool = False) -> Column:
    """``n`` points from low to high, evenly or evenly in the logarithm."""
    step = F.sequence(F.lit(0), F.lit(n - 1))
    if log:
        return F.transform(step, lambda k: F.pow(F.lit(low), 1 - k / (n - 1)) * F.pow(F.lit(high), k / (n - 1)))
    return F.transform(step, lambda k: low + (high - low) * k / (n - 1))


def positions_of(values: DataFrame, known: DataFrame, value: str = "t") -> DataFrame:
    """``values`` with the least ``pos`` of the equal value in ``known`` (value, pos); null if there is none."""
    first = known.groupBy(value).agg(F.min("pos").alias("pos"))
    return values.join(first, value, "left")
