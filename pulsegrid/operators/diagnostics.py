"""Goodness of fit of residuals, and first-order statistics of a model."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import kolmogorov_tail

col = F.col
BUCKETS = 4096


def exponential_ranks(residuals: DataFrame, key: str, value: str) -> DataFrame:
    """Adds rank (from 1) and n to (key, value), by the rank within a range bucket plus the buckets before, so that no key is sorted in one task."""
    rows = residuals.select(key, value).withColumn("u", 1 - F.exp(-F.greatest(value, F.lit(0.0))))
    # what is under 0, as rounding makes it, keeps its order in a bucket of its own
    rows = rows.withColumn("bucket", F.when(col(value) < 0, F.lit(-1)).otherwise(F.least(F.floor(col("u") * BUCKETS), F.lit(BUCKETS - 1))))
    counts = rows.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy("bucket")
    counts = counts.select(key, "bucket", (F.sum("c").over(w) - col("c")).alias("before"), F.sum("c").over(Window.partitionBy(key)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(value))
    return rows.withColumn("r", rank).join(counts, [key, "bucket"]).withColumn("rank", col("r") + col("before")).drop("bucket", "r", "before")


def ks_statistics(residuals: DataFrame, key: str = "k", value: str = "residual") -> DataFrame:
    """(key, n, ks): the largest distance between the empirical distribution and the unit exponential's."""
    placed = exponential_ranks(residuals, key, value)
    gap = F.greatest(col("rank") / col("n") - col("u"), col("u") - (col("rank") - 1) / col("n"))
    return placed.groupBy(key).agg(F.max("n").alias("n"), F.max(gap).alias("ks"))


def ks_p_value(ks: float, n: int) -> float:
    """The asymptotic tail with Stephens' correction."""
    root = math.sqrt(n)
    return kolmogorov_tail((root + 0.12 + 0.11 / root) * ks)


def medians(residuals: DataFrame, key: str = "k", value: str = "residual") -> DataFrame:
    """(key, median), from ranks."""
    placed = exponential_ranks(residuals, key, value)
    middle = placed.where((2 * col("rank") >= col("n")) & (2 * col("rank") <= col("n") + 2))
    low, high = F.min(F.when(2 * col("rank") >= col("n"), col(value))), F.max(F.when(2 * col("rank") <= col("n") + 2, col(value)))
    at_half = F.max(F.when(2 * col("rank") == col("n") + 1, col(value)))
    return middle.groupBy(key).agg(F.coalesce(at_half, (low + high) / 2).alias("median"))


def runs_test(residuals: DataFrame, key: str = "k", order: str = "m", value: str = "residual") -> DataFrame:
    """(key, runs, n_above, n_below, z): the Wald-Wolfowitz test about the median, in the order of a number.

    Signs are compared within buckets of that order, and the last sign of a bucket with the first of the next.
    """
    span = residuals.groupBy(key).agg(F.min(order).alias("low"), F.max(order).alias("high"))
    rows = residuals.select(key, order, value).join(medians(residuals, key, value), key).join(span, key).withColumn("above", (col(value) > col("median")).cast("int"))
    rows = rows.withColumn("bucket", F.floor((col(order) - col("low")) / (col("high") - col("low") + 1) * BUCKETS))
    change = F.coalesce(F.abs(col("above") - F.lag("above").over(Window.partitionBy(key, "bucket").orderBy(order))), F.lit(0))
    per = rows.withColumn("change", change).groupBy(key, "bucket").agg(
        F.sum("change").alias("change"), F.sum("above").alias("up"), F.count(F.lit(1)).alias("n"), F.min_by("above", order).alias("first"), F.max_by("above", order).alias("last")
    )
    joint = F.coalesce(F.abs(col("first") - F.lag("last").over(Window.partitionBy(key).orderBy("bucket"))), F.lit(0))
    out = per.withColumn("joint", joint).groupBy(key).agg((F.sum(col("change") + col("joint")) + 1).alias("runs"), F.sum("up").alias("n_above"), F.sum(col("n") - col("up")).alias("n_below"))
    a, b = col("n_above").cast("double"), col("n_below").cast("double")
    mean = 2 * a * b / (a + b) + 1
    variance = (mean - 1) * (mean - 2) / (a + b - 1)
    return out.withColumn("z", F.when(variance > 0, (col("runs") - mean) / F.sqrt(variance)))


def qq_points(residuals: DataFrame, key: str = "k", value: str = "residual") -> DataFrame:
    """(key, i, sample, model): order statistics against the unit exponential at Filliben's plotting positions."""
    rows = exponential_ranks(residuals, key, value).select(key, col(value).alias("sample"), col("rank").cast("int").alias("i"), "n")
    half = F.pow(F.lit(0.5), 1 / col("n"))
    p = F.when(col("i") == col("n"), half).when(col("i") == 1, 1 - half).otherwise((col("i") - 0.3175) / (col("n") + 0.365))
    return rows.select(key, "i", "sample", (-F.log1p(-p)).alias("model"))


def marked_adjacency(omega_l1: np.ndarray, expected_impact: np.ndarray) -> np.ndarray:
    """Branching matrix of a marked model: the kernels' L1 norms times the expected impacts of the sources' marks."""
    return np.asarray(omega_l1, float) * np.asarray(expected_impact, float)


def branching_ratio(adjacency: np.ndarray) -> float:
    """The spectral radius."""
    return float(np.max(np.abs(np.linalg.eigvals(adjacency))))


def stationary_rates(mu: np.ndarray, adjacency: np.ndarray) -> np.ndarray:
    """(I - A)^-1 mu."""
    return np.linalg.solve(np.eye(len(mu)) - adjacency, mu)


def baseline_from_rates(eta: np.ndarray, adjacency: np.ndarray) -> np.ndarray:
    """(I - A) eta."""
    return (np.eye(len(eta)) - adjacency) @ eta


def exogenous_share(mu: np.ndarray, adjacency: np.ndarray) -> float:
    return float(np.sum(mu) / np.sum(stationary_rates(mu, adjacency)))


def wasserstein(f: np.ndarray, g: np.ndarray, grid: np.ndarray) -> float:
    """The 1-Wasserstein distance of two weight vectors on a grid."""
    return float(np.sum(np.abs(np.cumsum(f / f.sum()) - np.cumsum(g / g.sum()))[:-1] * np.diff(grid)))


def edges(matrix: np.ndarray) -> list[tuple[int, int, float]]:
    return [(i, j, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
