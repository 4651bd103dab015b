"""Simulation of linear Hawkes processes by generations of a branching process, and of Poisson processes.

Every random number is a hash of (seed, lineage, draw), so that a result depends neither on the
partitioning nor on retries.  Offspring of a generation are one explode; each generation is written to
the checkpoint folder and the loop ends when one is empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.kernels import Kernel
from pulsegrid.operators.storage import cut_lineage

col = F.col


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from a hash of the seed and the keys."""
    h = F.xxhash64(F.xxhash64(F.lit(seed), *keys), F.lit(seed))
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


#: A Poisson draw is a sum of draws with means up to this, and the chance that one of these is over ``MOST`` is under the resolution of u.
PART, MOST = 8.0, 80
#: Steps of the sum that every draw takes; few need more.
OFTEN = 16


def _poisson_quantile(mean: Column, u: Column) -> Column:
    """The quantile of a Poisson law at u, by summing probabilities; for means up to ``PART``."""
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))

    def add(s: Column, k: Column) -> Column:
        more = s["c"] < u
        p = s["p"] * mean / k
        return F.struct(F.when(more, p).otherwise(s["p"]).alias("p"), F.when(more, s["c"] + p).otherwise(s["c"]).alias("c"), F.when(more, k).otherwise(s["n"]).alias("n"))

    rest = lambda s: F.aggregate(F.sequence(F.lit(OFTEN + 1), F.lit(MOST)), s, add, lambda s: s["n"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(OFTEN)), first, add, lambda s: F.when(s["c"] < u, rest(s)).otherwise(s["n"]))


def poisson(mean: Column, seed: int, *keys: Column) -> Column:
    """A Poisson number of any mean: a large mean is split evenly over independent draws, which the keys and their number seed.

    A number that a mean within one part makes 0, 1 or 2 is told by comparing u with plain sums; only what is over them takes the long sum.
    """
    parts = F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), parts), lambda i: _poisson_quantile(mean / parts, uniform(seed, *keys, i)))
    split = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    u, p0 = uniform(seed, *keys, F.lit(1)), F.exp(-mean)
    p1 = p0 * mean / F.lit(1)
    p2 = p1 * mean / F.lit(2)
    few = F.when(u <= p0, F.lit(0)).when(u <= p0 + p1, F.lit(1)).when(u <= p0 + p1 + p2, F.lit(2)).otherwise(_poisson_quantile(mean, u))
    return F.when(mean <= PART, few).otherwise(split)


def immigrants(spark: SparkSession, paths: int, mu: np.ndarray, horizon: float, seed: int, cell: float | None = None) -> DataFrame:
    """(path_id, dim, t, id, root_id, generation) of the first generation: Poisson counts in cells of time, uniform within."""
    cells = max(1, int(np.ceil(horizon * float(np.max(mu)) / 20))) if cell is None else max(1, int(np.ceil(horizon / cell)))
    width = horizon / cells
    rates = F.array(*[F.lit(float(m) * width) for m in mu])
    grid = spark.range(paths * len(mu) * cells).select((col("id") / (len(mu) * cells)).cast("long").alias("path_id"), F.pmod((col("id") / cells).cast("long"), F.lit(len(mu))).cast("int").alias("dim"), F.pmod("id", F.lit(cells)).alias("cell"))
    n = poisson(F.get(rates, col("dim")), seed, F.lit("immigrants"), col("path_id"), col("dim"), col("cell"))
    rows = grid.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), col("n"))))
    t = (col("cell") + uniform(seed, F.lit("time"), col("path_id"), col("dim"), col("cell"), col("i"))) * width
    rows = rows.select("path_id", "dim", t.alias("t"), F.xxhash64(F.lit(seed), "path_id", "dim", "cell", "i").alias("id"))
    return rows.select("path_id", "dim", "t", "id", col("id").alias("root_id"), F.lit(0).alias("generation"))


def offspring(parents: DataFrame, kernel: Callable[[int, int], Kernel], mean: np.ndarray, horizon: float, seed: int, impact: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """The next generation; mean[k, j] is the expected number of type-k children of a type-j parent."""
    d = len(mean)
    dims = parents.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(d)])))
    expected = F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in np.ravel(mean)]), F.when(col("dim").between(0, d - 1), col("k") * d + col("dim"))), F.lit(0.0))
    if impact:
        expected = expected * impact(col("k"), col("dim"), col("mark"))
    n = poisson(expected, seed, F.lit("children"), col("id"), col("k"))
    rows = dims.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), col("n"))))
    u = uniform(seed, F.lit("delay"), col("id"), col("k"), col("i"))
    delay = F.lit(0.0)
    for k in range(d):
        for j in range(d):
            if mean[k, j] > 0:
                delay = F.when((col("k") == k) & (col("dim") == j), kernel(k, j).delay(u)).otherwise(delay)
    rows = rows.select("path_id", col("k").alias("dim"), (col("t") + delay).alias("t"), F.xxhash64("id", "k", "i", F.lit(seed)).alias("id"), "root_id", (col("generation") + 1).alias("generation"))
    return rows.where(col("t") < horizon)


def simulate_hawkes(spark: SparkSession, *, paths: int, mu: np.ndarray, kernel: Callable[[int, int], Kernel], mean: np.ndarray, horizon: float, seed: int = 1, start: DataFrame | None = None, mark: Callable[[Column], Column] | None = None, impact=None, history: DataFrame | None = None, since: float = 0.0) -> DataFrame:
    """(path_id, dim, t, id, root_id, generation, mark) over [since, horizon).

    ``start`` replaces the immigrants, as for the descendants of given events.  ``mark`` makes a mark from a
    uniform number, and ``impact`` scales the offspring by it.  ``history`` (path_id, event_id, dim, t, mark) are events before ``since``,
    whose offspring after it is drawn too: by thinning, only children later than ``since`` stay, as the process is given up to then.
    """
    if np.max(np.abs(np.linalg.eigvals(mean))) >= 1:
        raise ValueError("the branching ratio must be under 1")
    marked = lambda df: df.withColumn("mark", mark(uniform(seed, F.lit("mark"), col("id"))) if mark else F.lit(None).cast("double"))
    first = immigrants(spark, paths, mu, horizon, seed).where(col("t") >= since) if start is None else start
    if history is not None:
        old = history.where(col("t") < since).select("path_id", "dim", "t", F.xxhash64("event_id", F.lit(seed)).alias("id"), "mark")
        born = offspring(old.withColumns({"root_id": col("id"), "generation": F.lit(0)}), kernel, mean, horizon, seed, impact)
        first = first.unionByName(born.where(col("t") >= since))
    now = cut_lineage(marked(first))
    everything = now
    while not now.isEmpty():
        now = cut_lineage(marked(offspring(now, kernel, mean, horizon, seed, impact)))
        everything = everything.unionByName(now)
    return everything


def simulate_poisson(spark: SparkSession, *, paths: int, compensator_at_end: float, inverse: Callable[[Column], Column], seed: int = 1) -> DataFrame:
    """(path_id, t): a unit-rate process on [0, compensator] carried back through the inverse compensator."""
    unit = immigrants(spark, paths, np.array([1.0]), compensator_at_end, seed)
    return unit.select("path_id", inverse(col("t")).alias("t"))


def thin(events: DataFrame, keep: Column, seed: int = 1) -> DataFrame:
    """Rejection: each event stays with probability ``keep``."""
    return events.where(uniform(seed, F.lit("thin"), col("id")) < keep)


def simulate_immigrants(spark: SparkSession, *, paths: int, mu: Column, most: float, dim: int, horizon: float, seed: int = 1) -> DataFrame:
    """Immigrants of one dimension with a time-dependent rate ``mu`` (of column t), at most ``most``: candidates thinned; as ``start`` of ``simulate_hawkes``."""
    all_of = immigrants(spark, paths, np.array([most]), horizon, seed + 7919 * dim)
    return thin(all_of, mu / F.lit(most), seed + dim).withColumn("dim", F.lit(dim))


def simulate_episodes(spark: SparkSession, *, horizons: list[float], **model) -> DataFrame:
    """One path for each horizon: all are simulated to the longest, and each is cut at its own, which is exact."""
    ends = F.array(*[F.lit(float(h)) for h in horizons])
    rows = simulate_hawkes(spark, paths=len(horizons), horizon=max(horizons), **model)
    return rows.where(col("t") < F.get(ends, col("path_id").cast("int")))


def one_step_ahead(spark: SparkSession, *, history: DataFrame, since: float, horizon: float, **model) -> DataFrame:
    """The next event of each path after its history, none if there is none before the horizon."""
    return next_events(simulate_hawkes(spark, history=history, since=since, horizon=horizon, **model))


def next_events(start: DataFrame) -> DataFrame:
    """The earliest event of each path."""
    return start.groupBy("path_id").agg(F.min(F.struct("t", "dim", "mark")).alias("e")).select("path_id", "e.t", "e.dim", "e.mark")
