"""Baseline intensities: mu(t), its integral from 0 to t, and the mean of mu^2 over [0, T]."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import Number, col, inverse_kepler

#: A piece of a rate: c0 + c1 t + amplitude cos(frequency t + phase) on [start, end).
Atom = tuple[float, float, float, float, float, float, float]


@dataclass(frozen=True)
class Constant:
    level: Number = 1.0

    def mu(self, t: Number) -> Column:
        return col(self.level) + 0 * col(t)

    def compensator(self, t: Number) -> Column:
        return col(self.level) * col(t)

    def mean_square(self, horizon: Number) -> Column:
        return col(self.level) * col(self.level) + 0 * col(horizon)

    def inverse(self, y: Number) -> Column:
        return col(y) / col(self.level)

    def atoms(self) -> list[Atom]:
        return [(0.0, math.inf, self.level, 0.0, 0.0, 0.0, 0.0)]


@dataclass(frozen=True)
class Linear:
    slope: Number = 0.0
    level: Number = 1.0

    def mu(self, t: Number) -> Column:
        return col(self.slope) * col(t) + col(self.level)

    def compensator(self, t: Number) -> Column:
        return col(self.slope) * col(t) * col(t) / 2 + col(self.level) * col(t)

    def mean_square(self, horizon: Number) -> Column:
        a, b, t = col(self.slope), col(self.level), col(horizon)
        return a * a * t * t / 3 + a * b * t + b * b

    def inverse(self, y: Number) -> Column:
        a, b = col(self.slope), col(self.level)
        return 2 * col(y) / (b + F.sqrt(b * b + 2 * a * col(y)))

    def atoms(self) -> list[Atom]:
        return [(0.0, math.inf, self.level, self.slope, 0.0, 0.0, 0.0)]


@dataclass(frozen=True)
class PiecewiseConstant:
    """levels[k] on [breaks[k], breaks[k + 1]); breaks begin with 0, the last level has no end."""

    breaks: tuple[float, ...]
    levels: tuple[float, ...]

    def _pieces(self):
        ends = (*self.breaks[1:], float("inf"))
        return zip(self.breaks, ends, self.levels, strict=True)

    def mu(self, t: Number) -> Column:
        out = F.lit(0.0)
        for start, _, level in self._pieces():
            out = F.when(col(t) >= start, F.lit(level)).otherwise(out)
        return out

    def _sum(self, t: Number, power: int) -> Column:
        out = F.lit(0.0)
        for start, end, level in self._pieces():
            out = out + level**power * F.greatest(F.least(col(t), F.lit(end)) - start, F.lit(0.0))
        return out

    def compensator(self, t: Number) -> Column:
        return self._sum(t, 1)

    def mean_square(self, horizon: Number) -> Column:
        return self._sum(horizon, 2) / col(horizon)

    def atoms(self) -> list[Atom]:
        return [(start, end, level, 0.0, 0.0, 0.0, 0.0) for start, end, level in self._pieces()]


@dataclass(frozen=True)
class Cosine:
    """delta + alpha (1 + cos(a t + b)), which stays over delta."""

    delta: Number = 0.0
    alpha: Number = 1.0
    a: Number = 1.0
    b: Number = 0.0

    def mu(self, t: Number) -> Column:
        return col(self.delta) + col(self.alpha) * (1 + F.cos(col(self.a) * col(t) + col(self.b)))

    def compensator(self, t: Number) -> Column:
        wave = (F.sin(col(self.a) * col(t) + col(self.b)) - F.sin(col(self.b))) / col(self.a)
        return (col(self.delta) + col(self.alpha)) * col(t) + col(self.alpha) * wave

    def mean_square(self, horizon: Number) -> Column:
        c, al, a, b, t = col(self.delta) + col(self.alpha), col(self.alpha), col(self.a), col(self.b), col(horizon)
        wave = (F.sin(a * t + b) - F.sin(b)) / a
        square = t / 2 + (F.sin(2 * (a * t + b)) - F.sin(2 * b)) / (4 * a)
        return (c * c * t + 2 * c * al * wave + al * al * square) / t

    def inverse(self, y: Number) -> Column:
        """The compensator is Kepler's equation in a t + b + pi, with eccentricity alpha / (delta + alpha)."""
        a, b, al, c = col(self.a), col(self.b), col(self.alpha), col(self.delta) + col(self.alpha)
        m = (a * col(y) + al * F.sin(b)) / c + b + math.pi
        return (inverse_kepler(m, al / c, 52) - b - math.pi) / a

    def atoms(self) -> list[Atom]:
        return [(0.0, math.inf, self.delta + self.alpha, 0.0, self.alpha, self.a, self.b)]


def _product(x: Atom, y: Atom, end: float) -> float:
    """The integral of two atoms' product from 0 to ``end``."""
    low, high = max(x[0], y[0], 0.0), min(x[1], y[1], end)
    if high <= low:
        return 0.0

    def at(t: float) -> float:
        (_, _, p0, p1, m, f, g), (_, _, q0, q1, n, h, k) = x, y
        out = p0 * q0 * t + (p0 * q1 + p1 * q0) * t * t / 2 + p1 * q1 * t**3 / 3
        for c0, c1, amp, w, v in ((p0, p1, n, h, k), (q0, q1, m, f, g)):
            if amp:
                s, c = math.sin(w * t + v), math.cos(w * t + v)
                out += amp * ((c0 + c1 * t) * s / w + c1 * c / (w * w))
        if m and n:
            for w, v in ((f - h, g - k), (f + h, g + k)):
                out += m * n / 2 * (math.cos(v) * t if w == 0 else math.sin(w * t + v) / w)
        return out

    return at(high) - at(low)


@dataclass(frozen=True)
class Sum:
    """A sum of baselines with number parameters: the mean square is the sum of their pairwise inner products."""

    parts: tuple

    def __add__(self, other: Sum) -> Sum:
        return Sum(self.parts + other.parts)

    def mu(self, t: Number) -> Column:
        return _added(p.mu(t) for p in self.parts)

    def compensator(self, t: Number) -> Column:
        return _added(p.compensator(t) for p in self.parts)

    def inner_products(self, horizon: float) -> list[list[float]]:
        """Means of the products of each two parts over [0, horizon]."""
        return [[sum(_product(a, b, horizon) for a in x.atoms() for b in y.atoms()) / horizon for y in self.parts] for x in self.parts]

    def mean_square(self, horizon: float) -> Column:
        return F.lit(math.fsum(v for row in self.inner_products(float(horizon)) for v in row))

    def k(self, kernel, t: Number, s: Number, of_part: Callable) -> Column:
        """The integral of phi(u) mu(u + s) from 0 to t, part by part; ``of_part(kernel, part, t, s)`` gives one."""
        return _added(of_part(kernel, p, t, s) for p in self.parts)

    def inverse(self, y: Number, high: Number, steps: int = 60) -> Column:
        """The time by which the compensator reaches y, if it does so before ``high``: by halving a bracket."""

        def halve(b: Column, _: Column) -> Column:
            middle = (b["low"] + b["high"]) / 2
            less = self.compensator(middle) < col(y)
            return F.struct(F.when(less, middle).otherwise(b["low"]).alias("low"), F.when(less, b["high"]).otherwise(middle).alias("high"))

        start = F.struct(F.lit(0.0).alias("low"), col(high).cast("double").alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda b: (b["low"] + b["high"]) / 2)


def _added(columns) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out
