"""Poisson fits and gradients: piecewise rates in closed form, cosines of unknown frequency from trigonometric sums, derivatives of both losses.

A fit reads the events once for each aggregate of a few numbers by dimension; frequencies to try are rows beside the events, which partial
sums gather before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

col = F.col


def fit_pieces(events: DataFrame, breaks: Sequence[float], dims: int, paths: int = 1) -> DataFrame:
    """(dim, piece, level, lse, loglik): the rate of each piece [breaks[i], breaks[i + 1]), which both losses take, and its part of them.

    The least-squares loss is the sum over pieces (a mean over paths and time), and so is the log-likelihood; pieces without an event have level 0.
    """
    span = breaks[-1] - breaks[0]
    pieces = [F.struct(F.lit(i).alias("piece"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False))]
    piece = F.lit(None).cast("int")
    for i in range(len(breaks) - 1):
        piece = F.when((col("t") >= breaks[i]) & (col("t") < breaks[i + 1]), i).otherwise(piece)
    counts = events.select("dim", piece.alias("piece")).where("piece is not null").groupBy("dim", "piece").agg(F.count(F.lit(1)).alias("n"))
    cells = events.sparkSession.range(dims).select(col("id").cast("int").alias("dim"), F.inline(F.array(*pieces)))
    out = cells.join(F.broadcast(counts), ["dim", "piece"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    level = col("n") / ((col("b") - col("a")) * paths)
    out = out.withColumn("level", level)
    lse = -col("level") * col("level") * (col("b") - col("a")) / span
    return out.select("dim", "piece", "level", lse.alias("lse"), F.when(col("n") > 0, col("n") * F.log("level") - col("n")).otherwise(0.0).alias("loglik"))


def _gram(f: float, t: float) -> np.ndarray:
    """Means over [0, t] of the products of 1, cos(f x), sin(f x)."""
    s1, c1, s2, c2 = math.sin(f * t) / (f * t), (1 - math.cos(f * t)) / (f * t), math.sin(2 * f * t) / (4 * f * t), (1 - math.cos(2 * f * t)) / (4 * f * t)
    return np.array([[1.0, s1, c1], [s1, 0.5 + s2, c2], [c1, c2, 0.5 - s2]])


@dataclass
class CosineFit:
    """level + cosine cos(f t) + sine sin(f t); ``alpha``, ``phase`` and ``delta`` are those of ``baselines.Cosine``."""

    dim: int
    frequency: float
    level: float
    cosine: float
    sine: float
    lse: float

    @property
    def alpha(self) -> float:
        return math.hypot(self.cosine, self.sine)

    @property
    def phase(self) -> float:
        return math.atan2(-self.sine, self.cosine)

    @property
    def delta(self) -> float:
        return self.level - self.alpha


def _profile(f: float, t: float, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The best (level, cosine, sine) at a frequency and its loss; ``b`` has the means of 1, cos, sin over the events per time."""
    x = np.linalg.solve(_gram(f, t), b)
    return x, float(-b @ x)


def fit_cosine(events: DataFrame, frequencies: Sequence[float], horizon: float, paths: int = 1, newton: int = 0) -> list[CosineFit]:
    """For each dimension the frequency of least loss among ``frequencies``, by one pass, and then ``newton`` steps on it, a pass each and one to begin.

    At a frequency the least-squares loss is a quadratic in (level, cosine, sine), for which the numbers of events and the sums of cos(f t) and sin(f t) are
    sufficient.  The rate may be negative somewhere; ``delta`` tells.  Of equal losses the first frequency stays.  A step that doesn't lower the loss ends the search.
    """
    total = float(horizon * paths)
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f")) for i, f in enumerate(frequencies)])).alias("x")
    turn = col("x.f") * col("t")
    sums = events.select("dim", "t", grid).groupBy("dim", "x.i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.cos(turn)).alias("c"), F.sum(F.sin(turn)).alias("s"))
    best: dict[int, CosineFit] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["dim"], r["i"])):  # a row for each dimension and frequency
        f = float(frequencies[r["i"]])
        x, lse = _profile(f, horizon, np.array([r["n"], r["c"], r["s"]]) / total)
        if r["dim"] not in best or lse < best[r["dim"]].lse:
            best[r["dim"]] = CosineFit(r["dim"], f, *map(float, x), lse)
    now = {k: x.frequency for k, x in best.items()} if newton else {}
    for turn in range(newton + 1):
        if not now:
            break
        f = F.create_map(*[F.lit(v) for item in now.items() for v in item])[col("dim")]
        c, s, t = F.cos(f * col("t")), F.sin(f * col("t")), col("t")
        rows = events.where(col("dim").isin(*now)).groupBy("dim")
        rows = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(n) for n, x in {"c": c, "s": s, "tc": t * c, "ts": t * s, "ttc": t * t * c, "tts": t * t * s}.items()]).collect()
        for r in rows:
            k = r["dim"]
            b, b1, b2 = (np.array(v) / total for v in ([r["n"], r["c"], r["s"]], [0.0, -r["ts"], r["tc"]], [0.0, -r["ttc"], -r["tts"]]))
            x, lse = _profile(now[k], horizon, b)
            if turn and lse > best[k].lse:
                del now[k]
                continue
            best[k] = CosineFit(k, now[k], *map(float, x), lse)
            now[k] += _newton_step(now[k], horizon, b, b1, b2)
    return [best[k] for k in sorted(best)]


def _newton_step(f: float, t: float, b: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> float:
    """A step on the frequency from the derivatives of the profile -b'G^-1 b; downhill where it bends the wrong way."""
    h = 1e-4 / t
    g, up, down = _gram(f, t), _gram(f + h, t), _gram(f - h, t)
    g1, g2 = (up - down) / (2 * h), (up - 2 * g + down) / (h * h)
    u = np.linalg.solve(g, b)
    u1 = np.linalg.solve(g, b1 - g1 @ u)
    slope = -2 * b1 @ u + u @ g1 @ u
    bend = -2 * b2 @ u - 2 * b1 @ u1 + 2 * u1 @ g1 @ u + u @ g2 @ u
    step = -slope / bend if bend > 0 else -math.copysign(0.25 / t, slope)
    return float(np.clip(step, -1 / t, 1 / t))


def poisson_gradients(events: DataFrame, baseline: Callable, params: Sequence[Sequence[float]], horizon: float, paths: int = 1, eps: float = 1e-6) -> DataFrame:
    """(k, i, by_lse, by_loglik): derivatives of both losses by each parameter of ``baseline(*params[k])``.

    Of the rate at the events they are sums over these, of the mean square and the compensator numbers; a baseline that states no derivatives has central differences.
    """
    spark, n = events.sparkSession, len(params[0])
    own = lambda k: [F.get(F.array(*[F.lit(float(p[i])) for p in params]), k) for i in range(n)]

    def slopes(f: Callable, k) -> list:
        values, out = own(k), []
        for i in range(n):
            h = eps * (1 + F.abs(values[i]))
            at = lambda sign, i=i, h=h: f(baseline(*[v + sign * h if i == j else v for j, v in enumerate(values)]))
            out.append((at(1) - at(-1)) / (2 * h))
        return out

    k, t, total = col("dim"), col("t"), float(horizon * paths)
    mu = baseline(*own(k)).mu(t)
    by_mu = slopes(lambda x: x.mu(t), k)
    seen = events.groupBy("dim").agg(*[F.sum(x).alias(f"m{i}") for i, x in enumerate(by_mu)], *[F.sum(x / mu).alias(f"l{i}") for i, x in enumerate(by_mu)])
    rows = spark.range(len(params)).select(col("id").cast("int").alias("dim")).join(F.broadcast(seen), "dim", "left")
    square, area = slopes(lambda x: x.mean_square(F.lit(float(horizon))), k), slopes(lambda x: x.compensator(F.lit(float(horizon))), k)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = [F.struct(F.lit(i).alias("i"), (square[i] - 2 * zero(f"m{i}") / total).alias("by_lse"), (zero(f"l{i}") - paths * area[i]).alias("by_loglik")) for i in range(n)]
    return rows.select(col("dim").alias("k"), F.inline(F.array(*each)))
