"""Sums of baselines, Kepler's series, mark laws and tabulated kernels against quadrature and sampling by quantiles."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import baselines, impacts, kernels, marks, scalars, tabulated
from pulsegrid.operators import simulate


def values(spark, column, at):
    return [r["v"] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(at)], "i int, x double").select("i", column.alias("v")).orderBy("i").collect()]


PARTS = (baselines.Constant(0.3), baselines.Linear(0.02, 0.1), baselines.Cosine(0.2, 0.4, 1.5, 0.3), baselines.Cosine(0.1, 0.2, 0.7, -1.0), baselines.PiecewiseConstant((0.0, 3.0, 8.0), (0.1, 0.5, 0.0)))


def rate(t):
    return 0.3 + 0.02 * t + 0.1 + 0.2 + 0.4 * (1 + np.cos(1.5 * t + 0.3)) + 0.1 + 0.2 * (1 + np.cos(0.7 * t - 1.0)) + np.where(t < 3, 0.1, np.where(t < 8, 0.5, 0.0))


def test_sums_of_baselines(spark):
    total = baselines.Sum(PARTS[:3]) + baselines.Sum(PARTS[3:])
    x = F.col("x")
    at = [0.0, 0.5, 2.9, 3.0, 7.5, 11.0]
    assert values(spark, total.mu(x), at) == pytest.approx(rate(np.array(at)).tolist())
    n = 120_000
    t = (np.arange(n) + 0.5) * 12.0 / n
    assert values(spark, total.mean_square(12.0), [0.0])[0] == pytest.approx(float(np.mean(rate(t) ** 2)), rel=1e-6)
    products = total.inner_products(12.0)
    assert np.allclose(products, np.transpose(products))
    assert values(spark, total.inverse(total.compensator(x), 20.0), at[1:]) == pytest.approx(at[1:], abs=1e-9)
    k = kernels.Exponential(0.8, 1.3)
    by_parts = baselines.Sum((baselines.Constant(0.3), baselines.Linear(0.02, 0.1))).k(k, 2.0, x, lambda k, p, t, s: k.linear_k(t, s, getattr(p, "slope", 0.0), p.level))
    assert values(spark, by_parts, [0.4]) == pytest.approx(values(spark, kernels.k_by_quadrature(k, lambda u: 0.4 + 0.02 * u, 2.0, x, 2000), [0.4]), abs=1e-8)


def test_kepler_series_and_cosine_inverse(spark):
    x = F.col("x")
    at = np.linspace(-3, 12, 40).tolist()
    for e in (0.0, 0.2, 0.6, 0.85):
        assert values(spark, scalars.inverse_kepler_series(scalars.kepler(x, e), e), at) == pytest.approx(at, abs=1e-9)
    with pytest.raises(ValueError):
        scalars.inverse_kepler_series(x, 1.0)
    n, e = 3, 0.5  # Bessel's integral
    u = (np.arange(20_000) + 0.5) * math.pi / 20_000
    assert scalars.bessel_multiples(e, 3)[2] == pytest.approx(float(np.mean(np.cos(n * u - n * e * np.sin(u)))), abs=1e-10)
    c = baselines.Cosine(0.1, 0.4, 1.5, 0.3)
    assert values(spark, c.inverse(c.compensator(x)), at[10:]) == pytest.approx(at[10:], abs=1e-9)


def test_a_cosine_rate_is_simulated_by_its_inverse(spark):
    c = baselines.Cosine(0.2, 0.5, 2 * math.pi / 10, 0.0)
    end = values(spark, c.compensator(F.lit(100.0)), [0.0])[0]
    rows = simulate.simulate_poisson(spark, paths=40, compensator_at_end=end, inverse=c.inverse, seed=3)
    t = np.array([r["t"] for r in rows.collect()])
    assert abs(len(t) - 40 * end) < 5 * math.sqrt(40 * end) and t.min() >= 0 and t.max() <= 100 + 1e-6
    assert np.mean(np.cos(2 * math.pi / 10 * t)) == pytest.approx(0.5 / 2 / 0.7, abs=0.06)


@pytest.mark.parametrize("law", [marks.Exponential(2.0), marks.Uniform(0.5, 2.0), marks.Normal(1.0, 0.3), marks.Categorical((0.2, 0.5, 0.3))])
def test_mark_laws_and_expected_impacts(spark, law):
    n = 40_000
    draws = spark.range(n).select(law.draw((F.col("id") + 0.5) / n).alias("x"))
    got = draws.agg(F.avg("x").alias("m"), F.avg(F.exp(-0.7 * F.col("x"))).alias("l")).first()
    assert got["m"] == pytest.approx(law.mean, abs=2e-3) and got["l"] == pytest.approx(law.laplace(0.7), abs=2e-3)
    assert marks.expected_impact(law, impacts.LINEAR, 0.4) == pytest.approx(1 + 0.4 * law.mean)
    square = impacts.Family(lambda p, x: 1 + p * x * x, lambda p, x: x * x, 0.0)
    assert marks.expected_impact(law, square, 0.5) == pytest.approx(draws.agg(F.avg(1 + 0.5 * F.col("x") * F.col("x"))).first()[0], abs=5e-3)


def test_vector_marks_have_independent_parts(spark):
    law = marks.Product((marks.Exponential(2.0), marks.Uniform(0.0, 1.0)))
    rows = spark.range(40_000).select(law.draw(lambda i: simulate.uniform(9, F.col("id"), F.lit(i))).alias("x"))
    got = rows.agg(F.avg((1 + 0.5 * F.col("x")[0]) * F.exp(-F.col("x")[1])), F.corr(F.col("x")[0], F.col("x")[1])).first()
    assert got[0] == pytest.approx(law.expected([impacts.LINEAR, impacts.EXPONENTIAL], [0.5, 1.0]), abs=0.01) and abs(got[1]) < 0.02
    assert marks.Categorical((0.25, 0.75)).expected((2.0, 4.0)) == 3.5 and marks.expected_impact(marks.Void(), impacts.LINEAR, 3.0) == 1.0
    assert marks.Exponential(1.0).laplace(-1.0) == math.inf


def test_tables_of_integrals_are_within_their_bound(spark):
    x, at = F.col("x"), [0.0, 1e-4, 0.3, 1.0, 4.4, 19.9, 20.0, 30.0]
    for f, exact in (
        (lambda t: 1.3 * np.exp(-1.3 * t), lambda t: 1 - math.exp(-1.3 * t)),
        (lambda t: np.where((t >= 1) & (t < 4), 1 / 3, 0.0), lambda t: min(max((t - 1) / 3, 0), 1)),
        (lambda t: t / 2.89 * np.exp(-t * t / 5.78), lambda t: 1 - math.exp(-t * t / 5.78)),
    ):
        table = tabulated.integral_table(f, 20.0, 1e-8)
        got = values(spark, table.at(x), at)
        assert all(abs(a - exact(min(t, 20.0))) <= 2 * table.error for a, t in zip(got, at, strict=True))
    assert sum(tabulated.KRONROD[:-1]) * 2 + tabulated.KRONROD[-1] == pytest.approx(2, abs=1e-14)
    assert sum(tabulated.GAUSS[:-1]) * 2 + tabulated.GAUSS[-1] == pytest.approx(2, abs=1e-14)
    k = tabulated.Tabulated(0.8, lambda t: 1.3 * F.exp(-1.3 * t), tabulated.integral_table(lambda t: 1.3 * np.exp(-1.3 * t), 25.0))
    closed = kernels.Exponential(0.8, 1.3)
    assert values(spark, kernels.upsilon_by_quadrature(k, k, x, 0.4, 400), [3.0]) == pytest.approx(values(spark, closed.upsilon(closed, x, 0.4), [3.0]), abs=1e-6)
    with pytest.raises(ValueError):
        tabulated.integral_table(lambda t: np.sin(1e6 * t) ** 2, 20.0, 1e-12, most=50)
