"""Power-law kernels in linear time: their density as a sum of exponentials with a stated bound of its error, through the exponential scan.

(1 + beta t)^(-1 - alpha) is the integral over x of exp((1 + alpha) x - e^x (1 + beta t)) / Gamma(1 + alpha), and the trapezoidal sum over a
grid of x, that is over a geometric grid of decays beta e^x, tends to it exponentially fast.  The bound has three parts: the sum's
own error, which is relative and follows from the strip in which the integrand is analytic, and what is cut off at both ends of the grid, which is absolute.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.expscan import exp_sums

col = F.col


@dataclass(frozen=True)
class ExponentialSum:
    """density(t) = sum of weights exp(-decays t); off by at most relative * density(t) + absolute."""

    weights: tuple[float, ...]
    decays: tuple[float, ...]
    relative: float
    absolute: float

    def density(self, t: float) -> float:
        return sum(w * math.exp(-b * t) for w, b in zip(self.weights, self.decays, strict=True))

    def mass(self, t: float) -> float:
        return sum(-w / b * math.expm1(-b * t) for w, b in zip(self.weights, self.decays, strict=True))


def _step_error(alpha: float, h: float) -> float:
    """The trapezoidal sum's relative error at step h: the best bound over strips of half-width a < pi / 2."""
    strips = (i / 200 * math.pi / 2 for i in range(1, 200))
    return min(2 * math.cos(a) ** (-1 - alpha) / math.expm1(2 * math.pi * a / h) for a in strips)


def power_law_sum(alpha: float, beta: float, tolerance: float = 1e-10) -> ExponentialSum:
    """The density alpha beta (1 + beta t)^(-1 - alpha) for all t >= 0, with a relative and an absolute error under ``tolerance`` (times alpha beta)."""
    h = 1.0
    while _step_error(alpha, h) > tolerance:
        h *= 0.97
    norm = alpha * beta / math.gamma(1 + alpha)
    low = math.floor(math.log(tolerance / 2 * math.gamma(2 + alpha)) / (1 + alpha) / h)
    # beyond x the integrand is under exp((1 + alpha) x - e^x), which falls faster than its own slope from there on
    high = 1
    tail = lambda n: math.exp((1 + alpha) * n * h - math.exp(n * h)) / max(math.exp(n * h) - 1 - alpha, 1e-300)
    while math.exp(high * h) <= 2 + alpha or tail(high) / math.gamma(1 + alpha) > tolerance / 2:
        high += 1
    grid = [n * h for n in range(low, high + 1)]
    cut = math.exp((1 + alpha) * low * h) / math.gamma(2 + alpha) + tail(high) / math.gamma(1 + alpha)
    return ExponentialSum(tuple(norm * h * math.exp((1 + alpha) * x - math.exp(x)) for x in grid), tuple(beta * math.exp(x) for x in grid), _step_error(alpha, h), alpha * beta * cut)


def power_law_scan(events: DataFrame, alpha: float, beta: float, productivity: Column | None = None, tolerance: float = 1e-10, masses: bool = False) -> DataFrame:
    """``events`` with ``excited``: the sum over predecessors of productivity times the power-law density, and with ``masses`` also ``integral``, that of its integral.

    ``productivity`` is a Column of the earlier event (its dimension, its mark); 1 without it.
    """
    law = power_law_sum(alpha, beta, tolerance)
    u = F.lit(1.0) if productivity is None else productivity
    terms = [(b, u) for b in law.decays] + [(0.0, u)] * masses
    rows = exp_sums(events, terms, [f"__s{i}" for i in range(len(terms))])
    excited = F.lit(0.0)
    for i, w in enumerate(law.weights):
        excited = excited + w * col(f"__s{i}")
    rows = rows.withColumn("excited", excited)
    if masses:
        integral = F.lit(0.0)
        for i, (w, b) in enumerate(zip(law.weights, law.decays, strict=True)):
            integral = integral + w / b * (col(f"__s{len(terms) - 1}") - col(f"__s{i}"))
        rows = rows.withColumn("integral", integral)
    return rows.drop(*[f"__s{i}" for i in range(len(terms))])


def power_law_intensity(events: DataFrame, mu: Sequence[float], gain: Sequence[float], alpha: float, beta: float, productivity: Column | None = None, tolerance: float = 1e-10) -> DataFrame:
    """(path_id, k, m, t, intensity): mu_k + gain_k times the excitation, as in self-exciting models of productivity by mark or type."""
    at = lambda v: F.get(F.array(*[F.lit(float(x)) for x in v]), col("dim"))
    rows = power_law_scan(events, alpha, beta, productivity, tolerance)
    return rows.select("path_id", col("dim").alias("k"), col("event_id").alias("m"), "t", (at(mu) + at(gain) * col("excited")).alias("intensity"))


def power_law_compensators(events: DataFrame, mu: Sequence[float], gain: Sequence[float], alpha: float, beta: float, productivity: Column | None = None, tolerance: float = 1e-10) -> DataFrame:
    """(path_id, k, m, t, compensator) of the same models, from the same scan; ``sums.residuals`` takes it."""
    at = lambda v: F.get(F.array(*[F.lit(float(x)) for x in v]), col("dim"))
    rows = power_law_scan(events, alpha, beta, productivity, tolerance, masses=True)
    return rows.select("path_id", col("dim").alias("k"), col("event_id").alias("m"), "t", (at(mu) * col("t") + at(gain) * col("integral")).alias("compensator"))
