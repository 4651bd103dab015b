"""Impact functions: the factor by which a mark scales the excitation of its event."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import Number, col, logistic


def constant(mark: Column) -> Column:
    return F.lit(1.0)


def linear(mark: Column, slope: Number) -> Column:
    return 1 + col(slope) * mark


@dataclass(frozen=True)
class Family:
    """Impacts of one free parameter: the value at (parameter, mark), its derivative by the parameter, and the parameter's least value."""

    value: Callable[[Number, Column], Column]
    slope: Callable[[Number, Column], Column]
    low: float


LINEAR = Family(lambda p, x: 1 + col(p) * x, lambda p, x: x + 0 * col(p), 0.0)
EXPONENTIAL = Family(lambda p, x: F.exp(-col(p) * x), lambda p, x: -x * F.exp(-col(p) * x), -float("inf"))
#: x^p of positive marks, as in productivity laws.
POWER = Family(lambda p, x: F.pow(x, col(p)), lambda p, x: F.log(x) * F.pow(x, col(p)), -float("inf"))


def linear_vector(marks: Column, slopes: Sequence[float]) -> Column:
    """1 + sum of slope times mark over an array of marks."""
    products = F.zip_with(marks, F.array(*[F.lit(float(v)) for v in slopes]), lambda x, v: x * v)
    return F.aggregate(products, F.lit(1.0), lambda a, x: a + x)


def exponential(mark: Column, rate: Number) -> Column:
    return F.exp(-col(rate) * mark)


def sigmoid(mark: Column, omega: Number, beta: Number, delta: Number) -> Column:
    """1 at 0 and below, 1 + omega at 1 and above; between, 1 + omega / 2 at delta, where the logistic's argument rises by beta."""
    steep = 4 * (1 - (2 * col(delta) - 1) * (2 * col(delta) - 1)) * col(beta)
    inner = logistic(steep * (mark - col(delta)) / (1 - (2 * mark - 1) * (2 * mark - 1)))
    return F.when(mark <= 0, F.lit(1.0)).when(mark >= 1, 1 + col(omega)).otherwise(1 + col(omega) * inner)


def categorical(category: Column, values: Sequence[float]) -> Column:
    """1 for category 0, then ``values``."""
    return F.when(category == 0, F.lit(1.0)).otherwise(F.get(F.array(*[F.lit(float(v)) for v in values]), category.cast("int") - 1))


def perceptron(marks: Column, bias: Number, slopes: Sequence[float]) -> Column:
    """logistic(bias + slopes . marks) / logistic(bias)."""
    return logistic(col(bias) + linear_vector(marks, slopes) - 1) / logistic(bias)


def expected(impact: Callable[[Column], Column], marks: DataFrame, mark: str = "mark") -> float:
    """The mean impact over a table of marks: those of the events, or draws from a law of marks."""
    return marks.agg(F.avg(impact(F.col(mark)))).first()[0]


def expected_linear(slope: float, mean: float) -> float:
    """Of 1 + slope * mark."""
    return 1 + slope * mean


def expected_exponential(rate: float, mark_rate: float) -> float:
    """Of exp(-rate * mark) for exponential marks."""
    return mark_rate / (mark_rate + rate)


def expected_categorical(values: Sequence[float], shares: Sequence[float]) -> float:
    return float(sum(p * v for p, v in zip(shares, (1.0, *values), strict=True)))


def separable(*factors: Column) -> Column:
    out = F.lit(1.0)
    for f in factors:
        out = out * f
    return out
