"""Excitation kernels as Column expressions.

A kernel gives phi (the density of excitation), psi (its integral from 0 to t) and, where it has a closed
form, upsilon(t, s) with another kernel: the integral over u from 0 to t of phi(u) other.phi(u + s), where the first
kernel belongs to the later event.  Parameters are numbers or Columns, so one plan can
look its parameters up by row.  ``gradient_*`` are the derivatives by the parameters in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import Number, col, difference_columns, gamma_cdf, gaussian_pdf, inverse_normal_cdf, normal_cdf, tri

ZERO = 0.0
#: Deviations beyond which a normal density is under 1e-17 of its peak.
TAIL = 9.0


@dataclass(frozen=True)
class Kernel:
    """omega scales a density: ``phi = omega * density``."""

    omega: Number = 1.0

    @property
    def params(self) -> dict[str, Number]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def density(self, t: Number) -> Column:
        raise NotImplementedError

    def mass(self, t: Number) -> Column:
        """The density's integral from 0 to t."""
        raise NotImplementedError

    def phi(self, t: Number) -> Column:
        return F.when(col(t) < 0, ZERO).otherwise(col(self.omega) * self.density(t))

    def psi(self, t: Number) -> Column:
        return F.when(col(t) <= 0, ZERO).otherwise(col(self.omega) * self.mass(t))

    def l1(self) -> Column:
        return col(self.omega)

    def reach(self) -> Number:
        """The time beyond which the density is 0 to double precision."""
        return math.inf

    def delay(self, u: Number) -> Column:
        """The delay at probability u: the inverse of the normed integral."""
        raise NotImplementedError(f"{type(self).__name__} has no inverse")

    def upsilon(self, other: Kernel, t: Number, s: Number) -> Column:
        rule = UPSILON.get((type(self), type(other)))
        if rule is None:
            raise NotImplementedError(f"no closed form for {type(self).__name__} with {type(other).__name__}; see upsilon_by_quadrature")
        return rule(self, other, col(t), col(s))


@dataclass(frozen=True)
class Exponential(Kernel):
    beta: Number = 1.0

    def density(self, t: Number) -> Column:
        return col(self.beta) * F.exp(-col(self.beta) * col(t))

    def mass(self, t: Number) -> Column:
        return 1 - F.exp(-col(self.beta) * col(t))

    def delay(self, u: Number) -> Column:
        return -F.log1p(-col(u)) / col(self.beta)

    def gradient_phi(self, t: Number) -> tuple[Column, Column]:
        w, b, t = col(self.omega), col(self.beta), col(t)
        e = F.exp(-b * t)
        return b * e, w * (1 - b * t) * e

    def gradient_psi(self, t: Number) -> tuple[Column, Column]:
        w, b, t = col(self.omega), col(self.beta), col(t)
        e = F.exp(-b * t)
        return 1 - e, w * t * e

    def gradient_own_upsilon(self, t: Number, s: Number) -> tuple[Column, Column]:
        """Of upsilon with itself: omega^2 beta / 2 e^(-beta s) (1 - e^(-2 beta t))."""
        w, b, t, s = col(self.omega), col(self.beta), col(t), col(s)
        es, et = F.exp(-b * s), F.exp(-2 * b * t)
        return w * b * es * (1 - et), w * w / 2 * es * ((1 - b * s) * (1 - et) + 2 * b * t * et)

    def constant_k(self, t: Number, level: Number) -> Column:
        """The integral of phi(u) mu(u + s) from 0 to t for a constant mu."""
        return col(level) * self.psi(t)

    def linear_k(self, t: Number, s: Number, slope: Number, level: Number) -> Column:
        """The same for mu(x) = slope x + level."""
        w, b, t, s, a, c = col(self.omega), col(self.beta), col(t), col(s), col(slope), col(level)
        e = F.exp(-b * t)
        return w * ((a * s + c) * (1 - e) + a * ((1 - e) / b - t * e))


@dataclass(frozen=True)
class DelayedExponential(Kernel):
    beta: Number = 1.0
    delta: Number = 0.0

    def density(self, t: Number) -> Column:
        b, past = col(self.beta), col(t) - col(self.delta)
        return F.when(past < 0, ZERO).otherwise(b * F.exp(-b * past))

    def mass(self, t: Number) -> Column:
        past = col(t) - col(self.delta)
        return F.when(past < 0, ZERO).otherwise(1 - F.exp(-col(self.beta) * past))

    def delay(self, u: Number) -> Column:
        return col(self.delta) - F.log1p(-col(u)) / col(self.beta)


@dataclass(frozen=True)
class PowerLaw(Kernel):
    alpha: Number = 1.0
    beta: Number = 1.0

    def density(self, t: Number) -> Column:
        a, b = col(self.alpha), col(self.beta)
        return a * b * F.pow(1 + b * col(t), -1 - a)

    def mass(self, t: Number) -> Column:
        return 1 - F.pow(1 + col(self.beta) * col(t), -col(self.alpha))

    def delay(self, u: Number) -> Column:
        return (F.pow(1 - col(u), -1 / col(self.alpha)) - 1) / col(self.beta)


@dataclass(frozen=True)
class DelayedPowerLaw(PowerLaw):
    delta: Number = 0.0

    def density(self, t: Number) -> Column:
        past = col(t) - col(self.delta)
        return F.when(past < 0, ZERO).otherwise(PowerLaw.density(self, past))

    def mass(self, t: Number) -> Column:
        past = col(t) - col(self.delta)
        return F.when(past < 0, ZERO).otherwise(PowerLaw.mass(self, past))

    def delay(self, u: Number) -> Column:
        return col(self.delta) + PowerLaw.delay(self, u)


@dataclass(frozen=True)
class Rayleigh(Kernel):
    beta: Number = 1.0

    def reach(self) -> Number:
        return TAIL * self.beta

    def density(self, t: Number) -> Column:
        b2 = col(self.beta) * col(self.beta)
        return col(t) / b2 * F.exp(-col(t) * col(t) / (2 * b2))

    def mass(self, t: Number) -> Column:
        return 1 - F.exp(-col(t) * col(t) / (2 * col(self.beta) * col(self.beta)))

    def delay(self, u: Number) -> Column:
        return col(self.beta) * F.sqrt(-2 * F.log1p(-col(u)))


@dataclass(frozen=True)
class Uniform(Kernel):
    width: Number = 1.0
    delta: Number = 0.0

    def reach(self) -> Number:
        return self.delta + self.width

    def density(self, t: Number) -> Column:
        past = col(t) - col(self.delta)
        return F.when((past < 0) | (past >= col(self.width)), ZERO).otherwise(1 / col(self.width))

    def mass(self, t: Number) -> Column:
        return F.least(F.greatest((col(t) - col(self.delta)) / col(self.width), F.lit(0.0)), F.lit(1.0))

    def delay(self, u: Number) -> Column:
        return col(self.delta) + col(u) * col(self.width)


@dataclass(frozen=True)
class Triangular(Kernel):
    """omega times a triangle of height 1: the L1 norm is omega (beta + delta) / 2."""

    alpha: Number = 0.0
    beta: Number = 1.0
    delta: Number = 1.0

    def reach(self) -> Number:
        return self.alpha + self.beta + self.delta

    def density(self, t: Number) -> Column:
        return tri(t, self.alpha, self.beta, self.delta)

    def mass(self, t: Number) -> Column:
        x, b, d = col(t) - col(self.alpha), col(self.beta), col(self.delta)
        rest = F.greatest(b + d - x, F.lit(0.0))
        return F.when(x <= 0, ZERO).when(x <= b, x * x / (2 * b)).otherwise((b + d) / 2 - rest * rest / (2 * d))

    def l1(self) -> Column:
        return col(self.omega) * (col(self.beta) + col(self.delta)) / 2

    def delay(self, u: Number) -> Column:
        b, d = col(self.beta), col(self.delta)
        area = col(u) * (b + d) / 2
        return col(self.alpha) + F.when(area <= b / 2, F.sqrt(2 * b * area)).otherwise(b + d - F.sqrt(2 * d * ((b + d) / 2 - area)))


@dataclass(frozen=True)
class Gaussian(Kernel):
    """omega times a normal density with mean delta and deviation beta, on t >= 0."""

    beta: Number = 1.0
    delta: Number = 0.0

    def reach(self) -> Number:
        return self.delta + TAIL * self.beta

    def density(self, t: Number) -> Column:
        return gaussian_pdf(t, self.delta, self.beta)

    def mass(self, t: Number) -> Column:
        return normal_cdf((col(t) - col(self.delta)) / col(self.beta)) - normal_cdf(-col(self.delta) / col(self.beta))

    def l1(self) -> Column:
        return col(self.omega) * normal_cdf(col(self.delta) / col(self.beta))

    def delay(self, u: Number) -> Column:
        low = normal_cdf(-col(self.delta) / col(self.beta))
        return col(self.delta) + col(self.beta) * inverse_normal_cdf(low + col(u) * (1 - low))


@dataclass(frozen=True)
class Gamma(Kernel):
    """omega times a gamma density of shape alpha and rate beta; alpha is a number."""

    alpha: float = 1.0
    beta: Number = 1.0

    def density(self, t: Number) -> Column:
        b, t = col(self.beta), col(t)
        return F.when(t <= 0, F.lit(1.0) * b if self.alpha == 1 else ZERO).otherwise(F.exp(self.alpha * F.log(b) + (self.alpha - 1) * F.log(t) - b * t) / math.gamma(self.alpha))

    def mass(self, t: Number) -> Column:
        return gamma_cdf(F.lit(float(self.alpha)), col(self.beta) * col(t))


@dataclass(frozen=True)
class Null(Kernel):
    def density(self, t: Number) -> Column:
        return F.lit(0.0)

    def mass(self, t: Number) -> Column:
        return F.lit(0.0)

    def l1(self) -> Column:
        return F.lit(0.0)


def gradient(kernel: Kernel, what: str, *at: Number, eps: float = 1e-6) -> list[Column]:
    """Derivatives of ``phi``, ``psi`` or another function of a kernel with number parameters: by central differences where it states none."""
    own = getattr(kernel, f"gradient_{what}", None)
    if own is not None:
        return list(own(*at))
    return difference_columns(lambda *p: getattr(type(kernel)(*p), what)(*at), list(kernel.params.values()), eps)


def gradient_cross_upsilon(x: Kernel, y: Kernel, t: Number, s: Number, eps: float = 1e-6) -> tuple[list[Column], list[Column]]:
    """Derivatives of upsilon(x, y) by the parameters of x and of y, which are numbers."""
    of_x = difference_columns(lambda *p: type(x)(*p).upsilon(y, t, s), list(x.params.values()), eps)
    return of_x, difference_columns(lambda *p: x.upsilon(type(y)(*p), t, s), list(y.params.values()), eps)


def gradient_exp_exp(x: Exponential, y: Exponential, t: Number, s: Number) -> tuple[list[Column], list[Column]]:
    """The same in closed form for two exponentials, as (omega, beta) of each."""
    wx, bx, wy, by, t, s = col(x.omega), col(x.beta), col(y.omega), col(y.beta), col(t), col(s)
    g, e, d = bx * by / (bx + by), F.exp(-(bx + by) * t), F.exp(-by * s)
    mass = d * (1 - e)
    by_x = wx * wy * ((by / (bx + by)) * (by / (bx + by)) * mass + g * d * t * e)
    by_y = wx * wy * ((bx / (bx + by)) * (bx / (bx + by)) * mass + g * d * (t * e - s * (1 - e)))
    return [wy * g * mass, by_x], [wx * g * mass, by_y]


def k_by_quadrature(kernel: Kernel, mu: Callable[[Column], Column], t: Number, s: Number, nodes: int = 64) -> Column:
    """The integral of phi(u) mu(u + s) from 0 to t by Simpson's rule, for baselines without a closed form."""
    t, s = col(t), col(s)
    h = t / nodes

    def add(total: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == nodes), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * kernel.phi(i * h) * mu(i * h + s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(nodes)), F.lit(0.0), add) * h / 3


def piecewise_k(kernel: Kernel, breaks: Sequence[float], levels: Sequence[float], t: Number, s: Number) -> Column:
    """The same for a piecewise constant mu: each level times psi between the bounds of its piece."""
    t, s, out = col(t), col(s), F.lit(0.0)
    for low, high, level in zip(breaks, [*breaks[1:], math.inf], levels, strict=True):
        a, b = (F.least(F.greatest(F.lit(x) - s, F.lit(0.0)), t) for x in (float(low), float(high)))
        out = out + level * (kernel.psi(b) - kernel.psi(a))
    return out


def _exp_exp(x: Exponential, y: Exponential, t: Column, s: Column) -> Column:
    bx, by = col(x.beta), col(y.beta)
    return col(x.omega) * col(y.omega) * (bx * by / (bx + by)) * F.exp(-by * s) * (1 - F.exp(-(bx + by) * t))


def _delayed(x: DelayedExponential, y: DelayedExponential, t: Column, s: Column) -> Column:
    bx, by = col(x.beta), col(y.beta)
    low = F.greatest(col(x.delta), col(y.delta) - s, F.lit(0.0))
    at = lambda u: F.exp(-bx * (u - col(x.delta)) - by * (u + s - col(y.delta)))
    return F.when(t <= low, ZERO).otherwise(col(x.omega) * col(y.omega) * (bx * by / (bx + by)) * (at(low) - at(t)))


def _gauss_gauss(x: Gaussian, y: Gaussian, t: Column, s: Column) -> Column:
    """The product of two normal densities is a normal density times a constant."""
    v1, v2 = col(x.beta) * col(x.beta), col(y.beta) * col(y.beta)
    m1, m2 = col(x.delta), col(y.delta) - s
    mean, std = (m1 * v2 + m2 * v1) / (v1 + v2), F.sqrt(v1 * v2 / (v1 + v2))
    mass = normal_cdf((t - mean) / std) - normal_cdf(-mean / std)
    return col(x.omega) * col(y.omega) * gaussian_pdf(m1, m2, F.sqrt(v1 + v2)) * mass


def _uniform_uniform(x: Uniform, y: Uniform, t: Column, s: Column) -> Column:
    """Both densities are flat, so upsilon is the time in which both hold."""
    low = F.greatest(col(x.delta), col(y.delta) - s, F.lit(0.0))
    high = F.least(col(x.delta) + col(x.width), col(y.delta) + col(y.width) - s, t)
    return col(x.omega) * col(y.omega) * F.greatest(high - low, F.lit(0.0)) / (col(x.width) * col(y.width))


def _tilted(e: Exponential, g: Gaussian, shift: Column, t: Column) -> Column:
    """The integral of omega beta e^(-beta (u + shift)) times the normal density of g over [0, t]."""
    b, v = col(e.beta), col(g.beta) * col(g.beta)
    mean = col(g.delta) - b * v
    mass = normal_cdf((t - mean) / col(g.beta)) - normal_cdf(-mean / col(g.beta))
    return col(e.omega) * col(g.omega) * b * F.exp(-b * shift - b * col(g.delta) + 0.5 * b * b * v) * mass


def _exp_gauss(x: Exponential, y: Gaussian, t: Column, s: Column) -> Column:
    return _tilted(x, Gaussian(y.omega, y.beta, col(y.delta) - s), F.lit(0.0), t)


def _gauss_exp(x: Gaussian, y: Exponential, t: Column, s: Column) -> Column:
    return _tilted(y, x, s, t)


UPSILON = {
    (Exponential, Exponential): _exp_exp,
    (DelayedExponential, DelayedExponential): _delayed,
    (Gaussian, Gaussian): _gauss_gauss,
    (Uniform, Uniform): _uniform_uniform,
    (Exponential, Gaussian): _exp_gauss,
    (Gaussian, Exponential): _gauss_exp,
    (Null, Null): lambda x, y, t, s: F.lit(0.0),
}


def upsilon_by_quadrature(x: Kernel, y: Kernel, t: Number, s: Number, nodes: int = 64) -> Column:
    """Upsilon of any two kernels by Simpson's rule on ``nodes`` (even) intervals of [0, t], or of the part of it that both kernels reach."""
    t, s = col(t), col(s)
    for kernel, shift in ((x, F.lit(0.0)), (y, s)):
        if not (isinstance(kernel.reach(), float) and math.isinf(kernel.reach())):
            t = F.greatest(F.least(t, col(kernel.reach()) - shift), F.lit(0.0))
    h = t / nodes

    def add(total: Column, k: Column) -> Column:
        weight = F.when((k == 0) | (k == nodes), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * x.phi(k * h) * y.phi(k * h + s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(nodes)), F.lit(0.0), add) * h / 3


@dataclass(frozen=True)
class Mixture:
    """A sum of kernels."""

    parts: tuple[Kernel, ...]

    def __add__(self, other: Mixture) -> Mixture:
        return Mixture(self.parts + other.parts)

    def phi(self, t: Number) -> Column:
        return _total(p.phi(t) for p in self.parts)

    def psi(self, t: Number) -> Column:
        return _total(p.psi(t) for p in self.parts)

    def l1(self) -> Column:
        return _total(p.l1() for p in self.parts)

    def is_basis_sum(self, free: set[str] = frozenset({"omega"})) -> bool:
        """Whether of all parts only the weights are free, so that the loss is a quadratic and a fit is one pass.

        ``free`` names the parameters that a fit may change; names that no part has don't count.
        """
        own = {name for part in self.parts for name in part.params}
        return bool(self.parts) and own & set(free) <= {"omega"}

    def delay(self, u: Number, pick: Number, weights: Sequence[float]) -> Column:
        """A delay at probability u of the part that ``pick`` (uniform) chooses by the weights."""
        out, cut = self.parts[-1].delay(u), 0.0
        chosen = []
        for part, w in zip(self.parts, weights, strict=True):
            cut += w / sum(weights)
            chosen.append((cut, part))
        for cut, part in reversed(chosen[:-1]):
            out = F.when(col(pick) < cut, part.delay(u)).otherwise(out)
        return out

    def upsilon(self, other: Mixture, t: Number, s: Number) -> Column:
        return _total(p.upsilon(q, t, s) for p in self.parts for q in other.parts)


def _total(columns) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out


def l2_dot(x: Exponential | Gaussian, y: Exponential | Gaussian) -> float:
    """The inner product of two kernels with number parameters."""
    cdf = lambda v: 0.5 * math.erfc(-v / math.sqrt(2))
    if isinstance(x, Exponential) and isinstance(y, Exponential):
        return x.omega * y.omega * x.beta * y.beta / (x.beta + y.beta)
    if isinstance(x, Gaussian) and isinstance(y, Gaussian):
        v1, v2 = x.beta**2, y.beta**2
        mean, std = (x.delta * v2 + y.delta * v1) / (v1 + v2), math.sqrt(v1 * v2 / (v1 + v2))
        peak = math.exp(-((x.delta - y.delta) ** 2) / (2 * (v1 + v2))) / math.sqrt(2 * math.pi * (v1 + v2))
        return x.omega * y.omega * peak * cdf(mean / std)
    e, g = (x, y) if isinstance(x, Exponential) else (y, x)
    mean = g.delta - e.beta * g.beta**2
    return e.omega * g.omega * e.beta * math.exp(-e.beta * g.delta + 0.5 * (e.beta * g.beta) ** 2) * cdf(mean / g.beta)


def l2_distance(x: Mixture, y: Mixture) -> float:
    """The squared L2 distance of two mixtures."""
    dot = lambda a, b: sum(l2_dot(p, q) for p in a.parts for q in b.parts)
    return dot(x, x) + dot(y, y) - 2 * dot(x, y)


def l2_projection(target: Mixture, family: Sequence[Exponential | Gaussian]) -> list[float]:
    """Weights, at least 0, of the sum of unit-weight ``family`` kernels nearest to ``target`` in L2: a quadratic of inner products."""
    n = len(family)
    x = [0.0] * n
    q = [[l2_dot(a, b) for b in family] for a in family]
    c = [sum(l2_dot(a, p) for p in target.parts) for a in family]
    for _ in range(10_000):
        before = list(x)
        for i in range(n):
            if q[i][i] > 0:
                x[i] = max(0.0, x[i] + (c[i] - sum(q[i][j] * x[j] for j in range(n))) / q[i][i])
        if max(abs(a - b) for a, b in zip(x, before, strict=True)) <= 1e-14 * (1 + max(x)):
            break
    return x


def kl_divergence(x: Gaussian, y: Gaussian) -> float:
    """Of the untruncated normal densities, x from y."""
    return math.log(y.beta / x.beta) + (x.beta**2 + (x.delta - y.delta) ** 2) / (2 * y.beta**2) - 0.5


def model_l2_distance(x: Sequence[Sequence[Mixture]], y: Sequence[Sequence[Mixture]]) -> list[list[float]]:
    """Squared L2 distances of the kernels of two models, for each pair of dimensions."""
    return [[l2_distance(a, b) for a, b in zip(p, q, strict=True)] for p, q in zip(x, y, strict=True)]
