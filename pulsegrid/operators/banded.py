"""Pairs within a kernel's reach, and fits of the shapes of such kernels.

Time is cut into blocks as long as the reach, so a predecessor that counts stands in the event's block or in the one before.  Each event is sent to
its own block and the next, and pairs are an equi-join on path and block: their number grows with the events and with how many of
them fall within the reach, not with the length of a path, and a long path is spread over its blocks.

For a kernel of given shape the loss of a receiver is a quadratic in its level and weights.  The terms of many shapes are one aggregate over single
events and one over the pairs, so a fit of free shapes tries a grid of them in one pass and then, pass by pass, the
neighbours of the best at half the step; each receiver has a shape of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.kernels import UPSILON, Kernel, upsilon_by_quadrature
from pulsegrid.operators.fit import bounded_quadratic, loss

col = F.col
Shape = tuple[float, ...]


def banded_pairs(events: DataFrame, reach: float) -> DataFrame:
    """(path_id, k, m, t, dt, j, mark, mark_m) of every event with each of its strict predecessors at most ``reach`` before it."""
    later = events.select("path_id", col("event_id").alias("m"), col("dim").alias("k"), "t", col("mark").alias("mark_m"), F.floor(col("t") / reach).alias("block"))
    earlier = events.select("path_id", col("dim").alias("j"), col("t").alias("t_n"), "mark", F.floor(col("t") / reach).alias("own"))
    earlier = earlier.withColumn("block", F.explode(F.array(col("own"), col("own") + 1))).drop("own")
    both = later.join(earlier, ["path_id", "block"]).withColumn("dt", col("t") - col("t_n"))
    return both.where((col("dt") > 0) & (col("dt") <= reach)).drop("block")


def banded_counts(events: DataFrame, reach: float) -> DataFrame:
    """(path_id, k, j, t, dt, n): ``banded_pairs`` counted by receiver, source and both times, for what depends on these alone.

    Events of a path and type at one time are one row first, so the pairs that are made grow with the distinct times and not with the square of how many events share one.
    """
    grouped = events.groupBy("path_id", "dim", "t").agg(F.count(F.lit(1)).alias("event_id"))
    p = banded_pairs(grouped.withColumn("mark", col("event_id")), reach)
    return p.select("path_id", "k", "j", "t", "dt", (col("mark_m") * col("mark")).alias("n"))


def reach_of(shapes: Sequence[Kernel]) -> float:
    out = max(float(k.reach()) for k in shapes)
    if not math.isfinite(out):
        raise ValueError("a kernel without a bounded reach needs all pairs, or the exponential scan")
    return max(out, 1e-9)


def _upsilon(kernel: Kernel, t, s):
    return kernel.upsilon(kernel, t, s) if (type(kernel), type(kernel)) in UPSILON else upsilon_by_quadrature(kernel, kernel, t, s)


def shape_terms(events: DataFrame, kernel: Callable[..., Kernel], shapes: Sequence[Shape], dims: int, horizon: float, paths: int = 1) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each shape and receiver k the (Q, c) of LSE_k = x'Qx - 2c'x over x = (level_k, weights of the sources); ``kernel(1.0, *shape)`` has weight 1.

    Shapes are rows beside the events and the pairs, so the plan is as small for many as for one.
    """
    total, width = float(horizon * paths), len(shapes[0])
    left = F.lit(float(horizon)) - col("t")
    table = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), *[F.lit(float(v)).alias(f"p{i}") for i, v in enumerate(s)]) for g, s in enumerate(shapes)])).alias("x")
    own = kernel(1.0, *[col(f"x.p{i}") for i in range(width)])
    out = [[(np.zeros((dims + 1, dims + 1)), np.zeros(dims + 1)) for _ in range(dims)] for _ in shapes]
    single = events.select("dim", "t", table).groupBy("x.g", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum(own.psi(left)).alias("psi"), F.sum(_upsilon(own, left, F.lit(0.0))).alias("own"))
    for r in single.collect():  # a row for each shape and dimension
        j, terms = r["dim"], out[r["g"]]
        terms[j][1][0] = r["n"] / total
        for q, _ in terms:
            q[0, 0] = 1.0
            q[0, j + 1] = q[j + 1, 0] = r["psi"] / total
            q[j + 1, j + 1] += r["own"] / total
    pairs = banded_counts(events, reach_of([kernel(1.0, *s) for s in shapes])).select("k", "j", "t", "dt", "n", table)
    for r in pairs.groupBy("x.g", "k", "j").agg(F.sum(col("n") * own.phi(col("dt"))).alias("phi"), F.sum(col("n") * _upsilon(own, left, col("dt"))).alias("ups")).collect():
        i, j, terms = r["k"], r["j"], out[r["g"]]
        terms[i][1][j + 1] = r["phi"] / total
        for q, _ in terms:
            q[i + 1, j + 1] += r["ups"] / total
            q[j + 1, i + 1] += r["ups"] / total
    return out


@dataclass
class ShapeFit:
    shape: list[Shape]  # by receiver
    level: np.ndarray
    omega: np.ndarray
    lse: np.ndarray
    tried: int


def fit_shapes(
    events: DataFrame, kernel: Callable[..., Kernel], grid: Sequence[Shape], dims: int, horizon: float, paths: int = 1, *, rounds: int = 0, steps: Shape | None = None, lows: Shape | None = None, min_level: float = 1e-10
) -> ShapeFit:
    """The best shape of ``grid`` for each receiver with its level and weights; then ``rounds`` passes over the neighbours of the best at halved ``steps``.

    ``kernel(1.0, *shape)`` makes a kernel; a coordinate does not go under ``lows``.  Of shapes with equal loss the first stays.
    """
    best: list[tuple | None] = [None] * dims
    tried, todo = set(), list(dict.fromkeys(tuple(map(float, s)) for s in grid))
    for turn in range(rounds + 1):
        if turn:
            scale, todo = 0.5**turn, []
            for k in range(dims):
                for i in range(len(steps)):
                    for sign in (-1, 1):
                        s = list(best[k][1])
                        s[i] += sign * scale * steps[i]
                        if lows is None or s[i] >= lows[i]:
                            todo.append(tuple(s))
            todo = [s for s in dict.fromkeys(todo) if s not in tried]
            if not todo:
                break
        tried.update(todo)
        for s, terms in zip(todo, shape_terms(events, kernel, todo, dims, horizon, paths), strict=True):
            for k, (q, c) in enumerate(terms):
                x = bounded_quadratic(q, c, np.r_[min_level, np.zeros(dims)])
                value = loss(q, c, x)
                if best[k] is None or value < best[k][0]:
                    best[k] = (value, s, x)
    return ShapeFit([b[1] for b in best], np.array([b[2][0] for b in best]), np.array([b[2][1:] for b in best]), np.array([b[0] for b in best]), len(tried))
