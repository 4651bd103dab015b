"""Strata of lags, exact sample sizes, and Neyman allocation.

A stratum is a band of lags h: the pairs of an event with its h-th last type-j predecessor.  ``sampling`` draws pairs of a stratum by index
without making them; here are the strata, the allocations, the estimate from a sample, and samples of rows that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

col = F.col


def lag_strata(max_lag: int, single: int = 30, bands: int = 9) -> list[tuple[int, int]]:
    """(low, high) lags, inclusive: one for each lag up to ``single``, then about ``bands`` log-spaced ones."""
    out = [(h, h) for h in range(1, min(single, max_lag) + 1)]
    low = len(out) + 1
    if low > max_lag:
        return out
    edges = sorted({round(low * (max_lag / low) ** (k / bands)) for k in range(1, bands + 1)})
    for high in edges:
        if high >= low:
            out.append((low, high))
            low = high + 1
    return out


def lagged_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``h``: 1 for an event's last predecessor of a dimension, 2 for the one before, and so on."""
    return pairs.withColumn("h", F.row_number().over(Window.partitionBy("m", "j").orderBy(col("t_n").desc())))


def with_strata(rows: DataFrame, strata: list[tuple[int, int]], by: str = "h") -> DataFrame:
    which = F.lit(None).cast("int")
    for k, (low, high) in enumerate(strata):
        which = F.when(col(by).between(low, high), k).otherwise(which)
    return rows.withColumn("stratum", which)


def sample_without_replacement(rows: DataFrame, allocation: dict[int, int], keys: list[str], seed: int) -> DataFrame:
    """Exactly min(q, size) rows of each stratum, those with the least seeded hashes of ``keys``."""
    q = F.lit(0)
    for k, n in allocation.items():
        q = F.when(col("stratum") == k, n).otherwise(q)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed), *keys), *keys))
    return rows.withColumn("rank", rank).where(col("rank") <= q).drop("rank")


def stratified_sum(sample: DataFrame, sizes: DataFrame, value: Column) -> DataFrame:
    """(total, variance): the sum of stratum means times sizes, and the variance of that estimate.

    A sample may miss the few rows that carry a sum, and its deviation with them, so each stratum's variance is that of
    its sample with one more draw as large as its largest (``augmented``).
    """
    return sum_of_strata(sample.groupBy("stratum").agg(*[x.alias(name) for name, x in stratum_moments(value).items()]), sizes)


def stratum_moments(value: Column) -> dict[str, Column]:
    """The aggregates of a stratum's sample that ``sum_of_strata`` takes."""
    return {"mean": F.avg(value), "var": F.coalesce(F.var_samp(value), F.lit(0.0)), "q": F.count(F.lit(1)), "most": F.max(F.abs(value))}


def sum_of_strata(per: DataFrame, sizes: DataFrame) -> DataFrame:
    """``stratified_sum`` from the moments of each stratum (stratum, mean, var, q, most)."""
    per = per.withColumn("var", augmented(col("var"), col("most"), col("q")))
    both = per.join(sizes, "stratum")
    left = 1 - col("q") / col("size")
    return both.agg(F.sum(col("mean") * col("size")).alias("total"), F.sum(col("size") * col("size") * left * col("var") / col("q")).alias("variance"))


def augmented(var, most, q):
    """A sample's variance allowing for one unseen row as large as its largest, in Columns or numbers."""
    return var + most * most / q


def neyman_allocation(sizes: dict[int, int], deviations: dict[int, float], budget: int) -> dict[int, int]:
    """Samples in proportion to size times deviation, at least two, so that a variance can be told, and at most the stratum's size; what is over a size goes to the others."""
    if budget >= sum(sizes.values()):
        return dict(sizes)
    weight = {k: n * (n / max(n - 1, 1)) ** 0.5 * deviations.get(k, 0.0) for k, n in sizes.items()}
    if not any(weight.values()):
        weight = dict.fromkeys(sizes, 1.0)
    whole: dict[int, int] = {}
    while True:
        open_ = {k: w for k, w in weight.items() if k not in whole}
        left, total = budget - sum(whole.values()), sum(open_.values())
        full = {k: sizes[k] for k, w in open_.items() if total and left * w / total >= sizes[k]}
        if not full:
            return whole | {k: min(sizes[k], max(2, round(left * w / total) if total else 2)) for k, w in open_.items()}
        whole |= full


def smoothed(old: dict[int, float], new: dict[int, float], keep: float = 0.5) -> dict[int, float]:
    """Exponential moving averages of deviations over iterations."""
    return {k: keep * old[k] + (1 - keep) * v if k in old else v for k, v in new.items()}


def adaptive_sum(rows: DataFrame, value: Column, keys: list[str], budget: int, rounds: int = 2, seed: int = 3) -> DataFrame:
    """The estimate of the sum of ``value`` over ``rows`` (stratum, keys) after re-allocating ``rounds`` times."""
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    known = {r["stratum"]: r["size"] for r in sizes.collect()}  # a row for each stratum
    allocation, seen = neyman_allocation(known, {}, budget), {}
    for r in range(rounds):
        drawn = sample_without_replacement(rows, allocation, keys, seed + r)
        found = drawn.groupBy("stratum").agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("s")).collect()
        seen = smoothed(seen, {x["stratum"]: x["s"] for x in found})
        allocation = neyman_allocation(known, seen, budget)
    return stratified_sum(sample_without_replacement(rows, allocation, keys, seed + rounds), sizes, value)


def true_allocation(pairs: DataFrame, value: Column, budget: int) -> dict[int, int]:
    """The best allocation, from the deviations over all pairs (stratum, ...): a diagnostic, as it needs every pair."""
    per = pairs.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("s")).collect()
    return neyman_allocation({r["stratum"]: r["n"] for r in per}, {r["stratum"]: r["s"] for r in per}, budget)


def merged_moments(n1: Column, mean1: Column, m2_1: Column, n2: Column, mean2: Column, m2_2: Column) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of two batches together."""
    n, gap = n1 + n2, mean2 - mean1
    return n, mean1 + gap * n2 / n, m2_1 + m2_2 + gap * gap * n1 * n2 / n
