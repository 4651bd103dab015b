"""Scalar functions as Column expressions; the gamma family, which Spark lacks, as whole-array Arrow UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Number = float | Column


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def prod_ratio(x: Number, y: Number) -> Column:
    """x y / (x + y), written so that large values don't overflow; 0 where both are 0."""
    x, y = col(x), col(y)
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(1 / (1 / x + 1 / y))


def share_ratio(x: Number, y: Number) -> Column:
    """x / (x + y); 0 where x is 0."""
    x, y = col(x), col(y)
    return F.when(x == 0, F.lit(0.0)).otherwise(1 / (1 + y / x))


def tri(t: Number, alpha: Number, beta: Number, delta: Number) -> Column:
    """A triangle of height 1 that rises over [alpha, alpha + beta] and falls over the next delta."""
    t, alpha, beta, delta = map(col, (t, alpha, beta, delta))
    up, down = (t - alpha) / beta, (alpha + beta + delta - t) / delta
    return F.when((t < alpha) | (t > alpha + beta + delta), F.lit(0.0)).when(t <= alpha + beta, up).otherwise(down)


def gaussian_pdf(t: Number, mean: Number = 0.0, std: Number = 1.0) -> Column:
    z = (col(t) - col(mean)) / col(std)
    return F.exp(-0.5 * z * z) / (col(std) * math.sqrt(2 * math.pi))


def logistic(x: Number) -> Column:
    """1 / (1 + e^-x) without overflow."""
    x = col(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logistic_pdf(x: Number) -> Column:
    return logistic(x) * (1 - logistic(x))


def kepler(theta: Number, epsilon: Number) -> Column:
    return col(theta) - col(epsilon) * F.sin(col(theta))


def inverse_kepler(y: Number, epsilon: Number, steps: int = 40) -> Column:
    """theta with theta - epsilon sin(theta) = y, by bisection on [y - epsilon, y + epsilon] over whole arrays."""

    @F.pandas_udf(T.DoubleType())
    def bisected(y: pd.Series, epsilon: pd.Series) -> pd.Series:
        at, e = y.to_numpy(float), epsilon.to_numpy(float)
        low, high = at - e, at + e
        for _ in range(steps):
            mid = (low + high) / 2
            left = mid - e * np.sin(mid) >= at
            low, high = np.where(left, low, mid), np.where(left, mid, high)
        return pd.Series((low + high) / 2)

    y, e = col(y), col(epsilon)
    return F.when(y.isNotNull() & e.isNotNull(), bisected(y, e))


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """By Horner's rule, the highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


# The rational approximations of the error function by W. J. Cody, Math. Comp. 23 (1969)
ERF_SMALL = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_LARGE = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346047, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def erfc(x: Number) -> Column:
    """1 less the error function, to double precision, as an expression."""

    def of(x: Column) -> Column:
        y = F.abs(x)
        small = x * _polynomial(x * x, ERF_SMALL[0]) / _polynomial(x * x, ERF_SMALL[1])
        middle = F.exp(-y * y) * _polynomial(y, ERFC_MIDDLE[0]) / _polynomial(y, ERFC_MIDDLE[1])
        z = 1 / (y * y)
        large = F.exp(-y * y) / y * (1 / math.sqrt(math.pi) - z * _polynomial(z, ERFC_LARGE[0]) / _polynomial(z, ERFC_LARGE[1]))
        tail = F.when(y <= 4, middle).otherwise(large)
        return F.when(y <= 0.46875, 1 - small).when(x > 0, tail).otherwise(2 - tail)

    return bound(col(x), of)


def normal_cdf(x: Number) -> Column:
    return 0.5 * erfc(-col(x) / math.sqrt(2))


# The starting approximation of the normal quantile by P. J. Acklam
QUANTILE_MIDDLE = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239), (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
QUANTILE_TAIL = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)


def inverse_normal_cdf(u: Number) -> Column:
    """By a rational start and two steps of Halley's rule; infinite at 0 and 1."""

    def of(u: Column) -> Column:
        low = F.least(u, 1 - u)
        q, r = u - 0.5, F.sqrt(-2 * F.log(low))
        middle = q * _polynomial(q * q, QUANTILE_MIDDLE[0]) / _polynomial(q * q, QUANTILE_MIDDLE[1])
        tail = _polynomial(r, QUANTILE_TAIL[0]) / _polynomial(r, QUANTILE_TAIL[1])
        x = F.when(low >= 0.02425, middle).when(q < 0, tail).otherwise(-tail)

        def closer(x: Column) -> Column:
            e = F.when(x < 0, normal_cdf(x) - u).otherwise(1 - u - normal_cdf(-x)) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
            return x - e / (1 + x * e / 2)

        return F.when(u <= 0, F.lit(-math.inf)).when(u >= 1, F.lit(math.inf)).otherwise(bound(bound(x, closer), closer))

    return bound(col(u), of)


@F.pandas_udf(T.DoubleType())
def gamma_function(x: pd.Series) -> pd.Series:
    return pd.Series(_GAMMA(x.to_numpy(float)))


_GAMMA, _LGAMMA = np.vectorize(math.gamma, otypes=[float]), np.vectorize(math.lgamma, otypes=[float])


def regularised_gamma(a: np.ndarray | float, x: np.ndarray | float) -> np.ndarray:
    """P(a, x) of whole arrays: the series below a + 1, the continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(np.isfinite(a) & np.isfinite(x), 0.0, np.nan)
    use = (out == 0) & (x > 0)
    scale = np.zeros_like(out)
    scale[use] = np.exp(-x[use] + a[use] * np.log(x[use]) - _LGAMMA(a[use])) if use.any() else 0.0
    low, high = use & (x < a + 1), use & (x >= a + 1)
    if low.any():
        n, term = a[low].copy(), 1 / a[low]
        total = term.copy()
        while np.any(np.abs(term) > np.abs(total) * 1e-16):
            n += 1
            term = term * x[low] / n
            total += term
        out[low] = total * scale[low]
    if high.any():
        p = a[high]
        b = x[high] + 1 - p
        c, d = np.full_like(b, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 500):
            an = -i * (i - p)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h *= d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[high] = 1 - scale[high] * h
    return out


@F.pandas_udf(T.DoubleType())
def gamma_cdf(a: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(regularised_gamma(a.to_numpy(float), x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def lower_gamma(a: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(regularised_gamma(a.to_numpy(float), x.to_numpy(float)) * _GAMMA(a.to_numpy(float)))


def gaussian_mass(start: Number, end: Number) -> Column:
    return normal_cdf(col(end)) - normal_cdf(col(start))


def kolmogorov_tail(c: float, terms: int = 100) -> float:
    """2 sum (-1)^(r-1) exp(-2 c^2 r^2)."""
    return 1.0 if c <= 0 else min(1.0, max(0.0, 2 * sum((-1) ** (r - 1) * math.exp(-2 * c * c * r * r) for r in range(1, terms + 1))))


def finite_difference(f, x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Central differences of a driver function."""
    x = np.asarray(x, float)
    out = np.empty_like(x)
    for i in range(len(x)):
        step = np.zeros_like(x)
        step[i] = eps
        out[i] = (f(x + step) - f(x - step)) / (2 * eps)
    return out


def difference_columns(f: Callable[..., Column], params: Sequence[float], eps: float = 1e-6) -> list[Column]:
    """Central differences of a parametrised expression by each of its parameters, for kernels that state no gradient."""
    out = []
    for i in range(len(params)):
        up, down = list(params), list(params)
        up[i], down[i] = up[i] + eps, down[i] - eps
        out.append((f(*up) - f(*down)) / (2 * eps))
    return out


def newton(step: Callable[[Column], Column], start: Column, n_iter: int = 30, low: float | None = None) -> Column:
    """theta after ``n_iter`` steps theta - step(theta), where step is the function over its derivative; not below ``low``."""

    def move(x: Column, _: Column) -> Column:
        new = x - step(x)
        return F.greatest(new, F.lit(low)) if low is not None else new

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_iter)), start.cast("double"), move)


def bucket_of(x: Number, grid: Sequence[float]) -> Column:
    """How many points of a rising grid are at or below x, less one; -1 before the first."""
    return F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= col(x))) - 1


def joined_grids(ends: Sequence[float], points: Sequence[int], start: float = 0.0) -> np.ndarray:
    """Evenly spaced points of consecutive intervals, in which a joint stands once."""
    starts = [start, *ends[:-1]]
    return np.unique(np.concatenate([np.linspace(a, b, n) for a, b, n in zip(starts, ends, points, strict=True)]))


def bessel_multiples(e: float, terms: int) -> list[float]:
    """J_n(n e) for n from 1 to ``terms``, each by downward recurrence from an order where it vanishes, normed by J_0 + 2 (J_2 + J_4 + ...) = 1."""
    out = []
    for n in range(1, terms + 1):
        x = n * e
        if x == 0:
            out.append(0.0)
            continue
        start = n + 2 * int(10 + math.sqrt(40.0 * n) + x) // 2
        start += start % 2
        above, here, wanted, norm = 0.0, 1e-300, 0.0, 0.0
        for m in range(start, 0, -1):
            above, here = here, 2 * m / x * here - above  # now of order m - 1
            if m - 1 == n:
                wanted = here
            if (m - 1) % 2 == 0:
                norm += here if m == 1 else 2 * here
            if abs(here) > 1e200:
                above, here, wanted, norm = above * 1e-200, here * 1e-200, wanted * 1e-200, norm * 1e-200
        out.append(wanted / norm)
    return out


def inverse_kepler_series(y: Number, e: float, tolerance: float = 1e-13) -> Column:
    """x with x - e sin(x) = y by the Kapteyn series y + sum 2 / n J_n(n e) sin(n y), for a number e under 1; as many terms as their bound asks for.

    |J_n(n e)| is at most r^n with r = e exp(root) / (1 + root), root = sqrt(1 - e^2).
    """
    if not 0 <= e < 1:
        raise ValueError("the series needs an eccentricity from 0 to under 1")
    root = math.sqrt(1 - e * e)
    ratio = e * math.exp(root) / (1 + root)
    terms = 1
    while e and 2 * ratio ** (terms + 1) / ((terms + 1) * (1 - ratio)) > tolerance:
        terms += 1
    weights = [2 * j / n for n, j in enumerate(bessel_multiples(e, terms), 1)]

    @F.pandas_udf(T.DoubleType())
    def series(y: pd.Series) -> pd.Series:
        """Clenshaw's recurrence over a whole array, so that a row takes one sine and one cosine."""
        at = y.to_numpy(float)
        turn, above, here = 2 * np.cos(at), np.zeros_like(at), np.zeros_like(at)
        for w in reversed(weights):
            above, here = here, w + turn * here - above
        return pd.Series(at + here * np.sin(at))

    y = col(y)
    return F.when(y.isNotNull(), series(y))
