"""Kernels known by their density alone: the integral is a table by adaptive quadrature with an error bound, looked up and interpolated.

The range is split until, on each piece, the 15-point Kronrod rule agrees with the 7-point Gauss rule within which it stands, and the cubic that
takes the integral and the density from the piece's ends agrees with the rule at the piece's middle.  A look-up is a binary search of the piece and that cubic, as a
Column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.kernels import Kernel
from pulsegrid.functions.scalars import Number, bound, col

# Nodes of the 15-point Kronrod rule on [-1, 1] from the outermost to 0, its weights, and those of the 7-point Gauss rule on every other node
NODES = (0.991455371120812639206854697526329, 0.949107912342758524526189684047851, 0.864864423359769072789712788640926, 0.741531185599394439863864773280788, 0.586087235467691130294144691693013, 0.405845151377397166906606412076961, 0.207784955007898467600689403773245, 0.0)
KRONROD = (0.022935322010529224963732008058970, 0.063092092629978553290700663189204, 0.104790010322250183839876322541518, 0.140653259715525918745189590510238, 0.169004726639267902826583426598550, 0.190350578064785409913256402421014, 0.204432940075298892414161999234649, 0.209482141084727828012999174891714)
GAUSS = (0.129484966168869693270611432679082, 0.279705391489276667901467771423780, 0.381830050505118944950369775488975, 0.417959183673469387755102040816327)
_X = np.array([*NODES, *(-x for x in NODES[-2::-1])])
_WK = np.array([*KRONROD, *KRONROD[-2::-1]])
_WG = np.zeros(15)
_WG[1::2] = [*GAUSS, *GAUSS[-2::-1]]


def _rule(f: Callable[[np.ndarray], np.ndarray], a: float, b: float) -> tuple[float, float]:
    """(integral, error) over [a, b]."""
    y = f((a + b) / 2 + (b - a) / 2 * _X) * (b - a) / 2
    k = float(_WK @ y)
    return k, abs(k - float(_WG @ y))


@dataclass(frozen=True)
class IntegralTable:
    """Points, the integral from 0 to each, and the density there; off by at most ``error`` anywhere."""

    points: tuple[float, ...]
    integrals: tuple[float, ...]
    densities: tuple[float, ...]
    error: float

    def at(self, t: Number) -> Column:
        """The integral from 0 to t; beyond the last point, that up to it."""
        n = len(self.points) - 1
        table = lambda v: F.array(*[F.lit(float(x)) for x in v])
        xs, ys, ds = table(self.points), table(self.integrals), table(self.densities)

        def of(t: Column) -> Column:
            def halve(s: Column, _: Column) -> Column:
                mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
                right = F.get(xs, mid) <= t
                return F.struct(F.when(right, mid).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(mid).alias("b"))

            start = F.struct(F.lit(0).alias("a"), F.lit(n).alias("b"))
            return bound(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(max(n, 2)))))), start, halve, lambda s: s["a"]), lambda i: cubic(i, t))

        def cubic(i: Column, t: Column) -> Column:
            x0, x1 = F.get(xs, i), F.get(xs, i + 1)
            h = x1 - x0
            u = F.least(F.greatest((t - x0) / h, F.lit(0.0)), F.lit(1.0))
            v = 1 - u
            return v * v * (1 + 2 * u) * F.get(ys, i) + u * u * (1 + 2 * v) * F.get(ys, i + 1) + h * u * v * (v * F.get(ds, i) - u * F.get(ds, i + 1))

        return bound(col(t).cast("double"), of)


def integral_table(density: Callable[[np.ndarray], np.ndarray], end: float, tolerance: float = 1e-9, most: int = 20_000) -> IntegralTable:
    """The table of a density on [0, end]; ``most`` pieces are the most that it may take, or it raises."""
    todo, pieces = [(0.0, float(end), 0)], []
    f = lambda x: np.asarray(density(np.asarray(x, float)), float)
    while todo:
        a, b, depth = todo.pop()
        m = (a + b) / 2
        (whole, e), (left, _), (fa, fb) = _rule(f, a, b), _rule(f, a, m), f(np.array([a, b]))
        middle = whole / 2 + (b - a) / 8 * (fa - fb)  # the cubic's rise up to the middle
        share = tolerance * max((b - a) / end, 1e-3)
        if (e <= share and abs(middle - left) <= tolerance / 4 and depth > 2) or b - a < 1e-12 * end:
            pieces.append((a, b, whole, e + abs(middle - left)))
        else:
            todo += [(m, b, depth + 1), (a, m, depth + 1)]
        if len(pieces) + len(todo) > most:
            raise ValueError("the density needs more pieces than allowed")
    points, rises = [0.0, *(b for _, b, _, _ in pieces)], np.cumsum([w for _, _, w, _ in pieces])
    rule_error = math.fsum(min(e, tolerance) for *_, e in pieces)
    return IntegralTable(tuple(points), (0.0, *map(float, rises)), tuple(map(float, f(np.array(points)))), max(tolerance, min(rule_error, 1.0)))


@dataclass(frozen=True)
class Tabulated(Kernel):
    """omega times a density given as a Column function; its integral from a table of the same density as a numpy function."""

    of: Callable[[Column], Column] = field(default=None, compare=False)
    table: IntegralTable = None

    @property
    def params(self) -> dict[str, Number]:
        return {"omega": self.omega}

    def reach(self) -> Number:
        return self.table.points[-1]

    def density(self, t: Number) -> Column:
        return F.when(col(t) > self.table.points[-1], 0.0).otherwise(self.of(col(t)))

    def mass(self, t: Number) -> Column:
        return self.table.at(t)

    def l1(self) -> Column:
        return col(self.omega) * self.table.integrals[-1]
