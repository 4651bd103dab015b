"""Laws of marks: draws by quantile functions from hashed uniforms, and expected impacts, closed where they are.

A law gives ``draw(u)`` for a uniform Column u in (0, 1), its ``mean`` and ``laplace(s)``, the mean of exp(-s mark).  A vector mark has independent parts, each
with a uniform of its own, so the mean of a product of impacts of single parts is the product of their means.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.functions.impacts import EXPONENTIAL, LINEAR, Family

col = F.col


@dataclass(frozen=True)
class Exponential:
    rate: float = 1.0

    def draw(self, u: Column) -> Column:
        return -F.log1p(-u) / self.rate

    @property
    def mean(self) -> float:
        return 1 / self.rate

    def laplace(self, s: float) -> float:
        if s <= -self.rate:
            return math.inf
        return self.rate / (self.rate + s)


@dataclass(frozen=True)
class Uniform:
    low: float = 0.0
    high: float = 1.0

    def draw(self, u: Column) -> Column:
        return self.low + (self.high - self.low) * u

    @property
    def mean(self) -> float:
        return (self.low + self.high) / 2

    def laplace(self, s: float) -> float:
        if s == 0 or self.high == self.low:
            return math.exp(-s * self.low)
        return math.exp(-s * self.low) * -math.expm1(-s * (self.high - self.low)) / (s * (self.high - self.low))


@dataclass(frozen=True)
class Normal:
    mean: float = 0.0
    deviation: float = 1.0

    def draw(self, u: Column) -> Column:
        return self.mean + self.deviation * scalars.inverse_normal_cdf(u)

    def laplace(self, s: float) -> float:
        return math.exp(-s * self.mean + (s * self.deviation) ** 2 / 2)


@dataclass(frozen=True)
class Categorical:
    """Category i with probability shares[i]; the mark is its number."""

    shares: tuple[float, ...]

    def draw(self, u: Column) -> Column:
        out, above = F.lit(float(len(self.shares) - 1)), 1.0
        for i in range(len(self.shares) - 1, 0, -1):
            above -= self.shares[i] / sum(self.shares)
            out = F.when(u < above, F.lit(float(i - 1))).otherwise(out)
        return out

    @property
    def mean(self) -> float:
        return sum(i * p for i, p in enumerate(self.shares)) / sum(self.shares)

    def laplace(self, s: float) -> float:
        return sum(p * math.exp(-s * i) for i, p in enumerate(self.shares)) / sum(self.shares)

    def expected(self, values: Sequence[float]) -> float:
        """The mean of values[category]."""
        return sum(p * v for p, v in zip(self.shares, values, strict=True)) / sum(self.shares)


@dataclass(frozen=True)
class Void:
    """No mark: draws are null and every impact is 1."""

    mean: float = 0.0

    def draw(self, u: Column) -> Column:
        return F.lit(None).cast("double")

    def laplace(self, s: float) -> float:
        return 1.0


@dataclass(frozen=True)
class Product:
    """A vector of independent marks."""

    parts: tuple

    def draw(self, uniforms: Callable[[int], Column]) -> Column:
        """An array of marks; ``uniforms(i)`` is the uniform of part i, such as ``simulate.uniform`` with i among its keys."""
        return F.array(*[p.draw(uniforms(i)) for i, p in enumerate(self.parts)])

    def expected(self, families: Sequence[Family], params: Sequence[float]) -> float:
        """The mean of the product of an impact of each part."""
        return math.prod(expected_impact(law, f, p) for law, f, p in zip(self.parts, families, params, strict=True))


def expected_impact(law, family: Family, param: float, nodes: int = 20_000) -> float:
    """The mean impact under a law: closed for linear and exponential impacts, else a midpoint sum over the law's quantiles."""
    if family is LINEAR:
        return 1 + param * law.mean
    if family is EXPONENTIAL:
        return law.laplace(param)
    from pyspark.sql import SparkSession

    u = (col("id") + 0.5) / nodes
    return SparkSession.active().range(nodes).select(family.value(param, law.draw(u)).alias("h")).agg(F.avg("h")).first()[0]
