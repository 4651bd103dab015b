"""Invariants that SQL doesn't state: scans against pairs, gradients against differences, fits of simulated paths."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import baselines, impacts, kernels, scalars
from pulsegrid.operators import diagnostics, expscan, fit, losses, paths, sampling, simulate, strata, sums
from pulsegrid.sources import cascades, store
from pulsegrid.streaming import online

ORDERING = [
    [1.75869445, 1.80061029, 1.82564278, 1.91613725, 1.92903655, 1.9636614, 2.00255562, 2.0473686, 2.13208584, 2.15969973],
    [1.72669995, 1.75597784, 1.7805469, 1.78599852, 1.79899688, 1.79990949, 1.8040088, 2.02449236, 2.04648297, 2.18191544],
]


def frame(spark, times, path=0):
    rows = [(path, 1000 * d + k, d, float(t), 1.0) for d, ts in enumerate(times) for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "path_id long, event_id long, dim int, t double, mark double")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_kappa_is_the_last_strictly_earlier_event(spark):
    got = {(r.i, r.m, r.j): r.kappa for r in paths.kappa(frame(spark, ORDERING), 2).collect()}
    for (i, m, j), k in got.items():
        assert k == sum(t < ORDERING[i][m] for t in ORDERING[j]) - 1


def test_ties_are_not_predecessors(spark):
    e = frame(spark, [[1.0, 1.0, 2.0], [1.0]])
    assert {(r.m, r.j): r.kappa for r in paths.kappa(e, 2).where("i = 0").collect()} == {(0, 0): -1, (0, 1): -1, (1, 0): -1, (1, 1): -1, (2, 0): 1, (2, 1): 0}
    assert sums.pairs(e).count() == 3


def test_scan_equals_pairs_far_beyond_overflow(spark):
    r = np.random.default_rng(1)
    times = [sorted(r.uniform(0, 3000, 150)), sorted(r.uniform(0, 3000, 100))]
    e = frame(spark, times)
    mu, w, b = [0.1, 0.2], [[0.2, 0.3], [0.1, 0.2]], [[5.0, 1.0], [0.7, 2.0]]
    pick = lambda m: lambda k, j: F.get(F.get(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m]), k), j)
    kernel = lambda k, j: kernels.Exponential(pick(w)(k, j), pick(b)(k, j))
    base = lambda k, t: F.get(F.array(*[F.lit(v) for v in mu]), k)
    fast = {x.m: x.intensity for x in expscan.exp_intensity(e, mu, w, b).collect()}
    slow = {x.m: x.intensity for x in sums.intensity(e, kernel, base, salts=3).collect()}
    assert fast.keys() == slow.keys()
    assert all(abs(fast[m] - slow[m]) < 1e-10 for m in fast)


@pytest.mark.parametrize("k", [kernels.Exponential(0.8, 1.3), kernels.DelayedExponential(0.8, 1.3, 0.4), kernels.PowerLaw(0.8, 1.5, 0.7), kernels.DelayedPowerLaw(0.8, 1.5, 0.7, 0.3), kernels.Rayleigh(0.8, 1.2), kernels.Uniform(0.8, 1.5, 0.5), kernels.Triangular(0.8, 0.2, 0.5, 0.9), kernels.Gaussian(0.8, 0.6, 1.1)], ids=lambda k: type(k).__name__)
def test_psi_is_the_integral_of_phi_and_delays_invert_it(spark, k):
    n = 20_000
    mids = spark.range(n).select(k.phi((F.col("id") + 0.5) * (2.0 / n)).alias("y"))
    assert mids.agg(F.sum("y") * (2.0 / n)).first()[0] == pytest.approx(value(spark, k.psi(2.0)), abs=1e-4)
    for u in (0.2, 0.7):
        assert value(spark, k.psi(k.delay(u)) / k.l1()) == pytest.approx(u, abs=1e-6)


@pytest.mark.parametrize("x, y", [(kernels.Exponential(0.8, 1.3), kernels.Exponential(0.5, 0.6)), (kernels.Exponential(0.8, 1.3), kernels.Gaussian(0.5, 0.6, 1.0)), (kernels.Gaussian(0.8, 0.7, 0.9), kernels.Exponential(0.5, 0.6)), (kernels.Gaussian(0.8, 0.7, 0.9), kernels.Gaussian(0.5, 0.6, 1.0))])
def test_upsilon_is_its_integral(spark, x, y):
    assert value(spark, x.upsilon(y, 2.0, 0.4)) == pytest.approx(value(spark, kernels.upsilon_by_quadrature(x, y, 2.0, 0.4, 200)), abs=1e-6)


def test_delayed_upsilon_is_zero_before_both_delays(spark):
    x, y = kernels.DelayedExponential(1.0, 1.0, 0.5), kernels.DelayedExponential(1.0, 1.0, 0.9)
    assert value(spark, x.upsilon(y, 0.2, 0.7)) == 0.0


def test_gradients_equal_differences(spark):
    at = lambda w, b: value(spark, kernels.Exponential(w, b).phi(0.7)), lambda w, b: value(spark, kernels.Exponential(w, b).psi(0.7)), lambda w, b: value(spark, kernels.Exponential(w, b).upsilon(kernels.Exponential(w, b), 0.7, 0.3))
    k = kernels.Exponential(0.8, 1.3)
    for f, g in zip(at, (k.gradient_phi(0.7), k.gradient_psi(0.7), k.gradient_own_upsilon(0.7, 0.3)), strict=True):
        want = scalars.finite_difference(lambda p, f=f: f(*p), np.array([0.8, 1.3]), 1e-5)
        assert [value(spark, c) for c in g] == pytest.approx(list(want), abs=1e-6)


def test_baselines_integrate(spark):
    n = 20_000
    for b in (baselines.Linear(0.3, 0.2), baselines.PiecewiseConstant((0.0, 1.0), (1.0, 2.0)), baselines.Cosine(0.1, 0.4, 1.5, 0.3)):
        got = spark.range(n).select(b.mu((F.col("id") + 0.5) * (3.0 / n)).alias("y")).agg(F.sum("y") * (3.0 / n), F.sum(F.col("y") * F.col("y")) / n).first()
        assert got[0] == pytest.approx(value(spark, b.compensator(3.0)), abs=1e-4)
        assert got[1] == pytest.approx(value(spark, b.mean_square(3.0)), abs=1e-3)
    assert value(spark, baselines.Linear(0.3, 0.2).inverse(baselines.Linear(0.3, 0.2).compensator(1.7))) == pytest.approx(1.7)


def test_impacts_and_gamma(spark):
    assert value(spark, impacts.perceptron(F.array(F.lit(0.0)), 0.3, [1.0])) == pytest.approx(1.0)
    assert value(spark, impacts.linear_vector(F.array(F.lit(1.0), F.lit(2.0)), [0.5, 0.25])) == pytest.approx(2.0)
    assert scalars.regularised_gamma(1.0, 0.7) == pytest.approx(1 - math.exp(-0.7))
    assert scalars.regularised_gamma(0.5, 3.0) == pytest.approx(math.erf(math.sqrt(3.0)))


def test_simulation_fit_and_residuals_agree(spark):
    mu, w, b = np.array([1.0]), np.array([[0.4]]), np.array([[1.5]])
    e = simulate.simulate_hawkes(spark, paths=8, mu=mu, kernel=lambda k, j: kernels.Exponential(float(w[k, j]), float(b[k, j])), mean=w, horizon=250.0, seed=3)
    e = e.select("path_id", F.col("id").alias("event_id"), "dim", "t", "mark")
    n = e.count()
    assert n == pytest.approx(8 * 250 / 0.6, rel=0.1)
    m, o, lse = fit.fit_fixed_decays(e, b, 250.0, 8)
    assert m[0] == pytest.approx(1.0, abs=0.2)
    assert o[0, 0] == pytest.approx(0.4, abs=0.1)
    kernel = lambda k, j: kernels.Exponential(float(o[0, 0]), 1.5)
    loss = sums.least_squares(e, kernel, lambda k: F.lit(float(m[0])), 1, 250.0, 8).first()["lse"]
    assert loss == pytest.approx(lse[0], abs=1e-8)
    res = sums.residuals(sums.compensators(e, lambda k, j: kernels.Exponential(0.4, 1.5), lambda k, t: t))
    ks = diagnostics.ks_statistics(res).first()
    assert diagnostics.ks_p_value(ks["ks"], ks["n"]) > 1e-3
    again = simulate.simulate_hawkes(spark, paths=8, mu=mu, kernel=lambda k, j: kernels.Exponential(0.4, 1.5), mean=w, horizon=250.0, seed=3)
    assert again.count() == n
    with pytest.raises(ValueError):
        simulate.simulate_hawkes(spark, paths=1, mu=mu, kernel=kernel, mean=np.array([[1.1]]), horizon=1.0)


def test_solvers_reach_the_bounded_minimum():
    q, c, low = np.array([[2.0, 0.3], [0.3, 1.0]]), np.array([1.0, -0.5]), np.zeros(2)
    want = fit.bounded_quadratic(q, c, low)
    for solver in (fit.Adam(fit.Schedule(0.02)), fit.Momentum(fit.Schedule(0.02)), fit.RMSprop(fit.Schedule(0.02, "exponential", period=150, least=1e-6))):
        x = fit.descend(lambda x: 2 * (q @ x - c), np.ones(2), low, solver, 2000)
        assert x == pytest.approx(want, abs=1e-2)


def test_stratified_sums_are_near_the_exact_one(spark):
    e = frame(spark, [sorted(np.random.default_rng(6).uniform(0, 50, 80)), sorted(np.random.default_rng(7).uniform(0, 50, 60))])
    bands = strata.lag_strata(200, 4, 3)
    got = sampling.adaptive_pair_sum(e, 2, bands, {"x": F.exp(-F.col("dt"))}, 400).first()
    exact = sums.pairs(e).agg(F.sum(F.exp(-F.col("dt"))).alias("x"), F.count(F.lit(1)).alias("n")).first()
    assert got["size"] == exact["n"] and abs(got["total"] - exact["x"]) <= 5 * math.sqrt(got["variance"])
    whole = sampling.adaptive_pair_sum(e, 2, bands, {"x": F.exp(-F.col("dt"))}, 10**6).first()
    assert whole["total"] == pytest.approx(exact["x"]) and whole["variance"] == pytest.approx(0.0)
    rows = spark.range(5000).select(F.pmod("id", F.lit(4)).cast("int").alias("stratum"), "id", (F.col("id") % 97).cast("double").alias("v"))
    exact = rows.agg(F.sum("v")).first()[0]
    got = strata.adaptive_sum(rows, F.col("v"), ["id"], 1500).first()
    assert abs(got["total"] - exact) < 5 * math.sqrt(got["variance"])
    assert strata.lag_strata(3) == [(1, 1), (2, 2), (3, 3)]
    drawn = strata.sample_without_replacement(rows, {0: 7, 1: 5000, 2: 0, 3: 1}, ["id"], 1).groupBy("stratum").count().collect()
    assert {r["stratum"]: r["count"] for r in drawn} == {0: 7, 1: 1250, 3: 1}


def test_normal_functions_equal_the_library(spark):
    from statistics import NormalDist

    xs = [-30.0, -8.0, -5.1, -4.0, -1.5, -0.3, 0.0, 0.2, 0.66, 0.67, 2.0, 3.9, 4.1, 6.0, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-12, abs=1e-300) for r in got)
    us = [1e-12, 1e-5, 0.02, 0.3, 0.5, 0.9, 0.98, 0.99999]
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", scalars.inverse_normal_cdf(F.col("u")).alias("x")).collect()
    assert all(r.x == pytest.approx(NormalDist().inv_cdf(r.u), rel=1e-9, abs=1e-12) for r in got)
    assert value(spark, scalars.inverse_normal_cdf(0.0)) == -math.inf and value(spark, scalars.inverse_normal_cdf(1.0)) == math.inf


def test_poisson_numbers_have_any_mean(spark):
    for mean in (0.3, 15.0, 300.0, 2000.0):
        got = spark.range(2000).select(simulate.poisson(F.lit(mean), 5, F.col("id")).alias("n")).agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).first()
        assert got.m == pytest.approx(mean, abs=5 * math.sqrt(mean / 2000)) and got.v == pytest.approx(mean, rel=0.2)


def test_sigmoid_impact(spark):
    f = lambda x: value(spark, impacts.sigmoid(F.lit(x), 0.5, 1.5, 0.4))
    assert f(0.4) == pytest.approx(1.25) and f(0.0) == 1.0 and f(1.0) == 1.5
    slope = (f(0.4 + 1e-5) - f(0.4 - 1e-5)) / 2e-5
    assert slope == pytest.approx(0.5 * 1.5 / 4 * 4, rel=1e-4)  # omega beta: the two curvatures cancel at delta


def test_blocks_equal_whole_paths(spark):
    """Ranks, kappa, counts and look-ups with blocks of a few events, ties and empty stretches among them."""
    from pulsegrid.operators import blocks

    r = np.random.default_rng(3)
    times = [sorted(np.round(r.uniform(0, 40, 60)) / 2), sorted(np.round(r.uniform(5, 9, 30)) / 2)]
    e = frame(spark, times).unionByName(frame(spark, [[100.0, 3.0]], path=1))
    for width in (0.7, 3.0, 1e6):
        got = {(x.path_id, x.i, x.m, x.j): x.kappa for x in blocks.kappa(e, 2, width).collect()}
        assert len(got) == 2 * e.count()
        for (p, i, m, j), k in got.items():
            own = times if p == 0 else [[3.0, 100.0], []]
            assert k == sum(t < own[i][m] for t in own[j]) - 1
        at = [0.0, 2.5, 2.6, 4.0, 20.0, 99.0]
        q = spark.createDataFrame([(n, 0, t) for n, t in enumerate(at)], "query_id long, path_id long, t double")
        both = [(t, d) for d, ts in enumerate(times) for t in ts]
        for forward, inclusive in ((True, False), (True, True), (False, False), (False, True)):
            found = {x.query_id: x.t_event for x in blocks.look_up(q, e, forward, inclusive, width).collect()}
            for n, t in enumerate(at):
                near = [x for x, _ in both if (x > t if forward else x < t) or inclusive and x == t]
                assert found[n] == (min(near, default=None) if forward else max(near, default=None))
        counts = {x.query_id: (x.n_0, x.n_1) for x in blocks.counting_process(q, e, 2, width).collect()}
        assert counts == {n: tuple(sum(x <= t for x in ts) for ts in times) for n, t in enumerate(at)}


def test_gradients_of_the_loss_equal_differences(spark):
    from pulsegrid.operators import losses

    r = np.random.default_rng(4)
    e = frame(spark, [sorted(r.uniform(0, 60, 40)), sorted(r.uniform(0, 60, 30))])
    mu, w, b = np.array([0.3, 0.2]), np.array([[0.2, 0.3], [0.1, 0.2]]), np.array([[1.5, 1.0], [0.7, 2.0]])

    def loss_of(x, k):
        m, o, d = x[0], x[1:3], x[3:5]
        beta = b.copy()
        beta[k] = d
        q, c = fit.quadratic_terms(e, beta, 60.0)[k]
        return fit.loss(q, c, np.r_[m, o])

    g = losses.exponential_gradient(e, mu, w, b, 60.0)
    for k in range(2):
        want = scalars.finite_difference(lambda x, k=k: loss_of(x, k), np.r_[mu[k], w[k], b[k]], 1e-4)
        assert [g[0][k], *g[1][k], *g[2][k]] == pytest.approx(list(want), abs=1e-7)


def test_fits_of_bases_equal_fits_of_decays_and_meet_their_conditions(spark):
    r = np.random.default_rng(5)
    e = frame(spark, [sorted(r.uniform(0, 80, 60)), sorted(r.uniform(0, 80, 40))])
    b = np.full((2, 2), 1.2)
    m, w, lse = fit.fit_fixed_decays(e, b, 80.0)
    m2, w2, lse2 = fit.fit_bases(e, lambda p: lambda k, j: kernels.Exponential(1.0, 1.2), 1, 2, 80.0)
    assert m2 == pytest.approx(m) and w2[:, :, 0] == pytest.approx(w) and lse2 == pytest.approx(lse)
    gauss = (kernels.Gaussian(1.0, 0.5, 1.0), kernels.Gaussian(1.0, 1.0, 3.0))
    m3, w3, lse3 = fit.fit_bases(e, lambda p: lambda k, j: gauss[p], 2, 2, 80.0)
    assert np.all(w3 >= 0) and np.all(lse3 < 0)
    for k, (q, c) in enumerate(losses.basis_terms(e, lambda p: lambda k, j: gauss[p], 2, 2, 80.0)):
        x = np.r_[m3[k], w3[k].ravel()]
        slope = q @ x - c  # 0 where a value is free, none downwards where it is at its bound
        assert np.all(slope > -1e-8) and np.all(np.abs(slope[x > 1e-9]) < 1e-8)
    mixture = kernels.Mixture(tuple(kernels.Gaussian(float(w3[0, 0, p]), g.beta, g.delta) for p, g in enumerate(gauss)))
    assert mixture.is_basis_sum() and not mixture.is_basis_sum({"omega", "beta"})
    assert mixture.is_basis_sum({"omega", "alpha"}) and not kernels.Mixture(()).is_basis_sum()
    mu, omega, beta, log = fit.fit_exponential(e, b, 80.0, n_iter=4)
    assert len(log) == 4 and sum(fit.fit_fixed_decays(e, beta, 80.0)[2]) <= log[0][2] + 1e-9


def test_projection_divergence_and_cross_gradients(spark):
    target = kernels.Mixture((kernels.Exponential(0.3, 1.0), kernels.Exponential(0.2, 3.0)))
    assert kernels.l2_projection(target, [kernels.Exponential(1.0, 1.0), kernels.Exponential(1.0, 3.0)]) == pytest.approx([0.3, 0.2], abs=1e-6)
    assert kernels.kl_divergence(kernels.Gaussian(1.0, 2.0, 1.0), kernels.Gaussian(1.0, 2.0, 1.0)) == 0
    x, y = kernels.Exponential(0.8, 1.3), kernels.Exponential(0.5, 0.6)
    exact, by_difference = kernels.gradient_exp_exp(x, y, 0.7, 0.3), kernels.gradient_cross_upsilon(x, y, 0.7, 0.3)
    for a, b in zip(exact, by_difference, strict=True):
        assert [value(spark, c) for c in a] == pytest.approx([value(spark, c) for c in b], abs=1e-6)
    g = kernels.Gamma(0.8, 2.5, 1.3)
    n = 20_000
    total = spark.range(n).select(g.phi((F.col("id") + 0.5) * (2.0 / n)).alias("y")).agg(F.sum("y") * (2.0 / n)).first()[0]
    assert total == pytest.approx(value(spark, g.psi(F.lit(2.0))), abs=1e-5)
    pieces = baselines.PiecewiseConstant((0.0, 1.0), (1.0, 2.0))
    assert value(spark, kernels.piecewise_k(x, (0.0, 1.0), (1.0, 2.0), 2.0, 0.4)) == pytest.approx(value(spark, kernels.k_by_quadrature(x, pieces.mu, 2.0, 0.4, 2000)), abs=1e-3)
    assert [value(spark, c) for c in kernels.gradient(kernels.Rayleigh(0.8, 1.2), "phi", 0.7)][0] == pytest.approx(value(spark, kernels.Rayleigh(1.0, 1.2).phi(0.7)), abs=1e-6)


def test_simulation_after_a_history(spark):
    mu, w, b = np.array([0.5]), np.array([[0.6]]), 1.0
    model = dict(mu=mu, kernel=lambda k, j: kernels.Exponential(0.6, b), mean=w)
    past = spark.range(200).select(F.lit(0).cast("long").alias("path_id"), F.col("id").alias("event_id"), F.lit(0).alias("dim"), (9.0 + F.col("id") / 200).alias("t"), F.lit(1.0).alias("mark"))
    rows = simulate.simulate_hawkes(spark, paths=1, horizon=30.0, since=10.0, history=past, seed=3, **model)
    alone = simulate.simulate_hawkes(spark, paths=1, horizon=30.0, since=10.0, seed=3, **model)
    assert rows.agg(F.min("t")).first()[0] >= 10.0 and rows.count() > alone.count() + 60  # some 73 children after 10, and theirs
    after = simulate.one_step_ahead(spark, history=past, since=10.0, horizon=30.0, paths=1, seed=3, **model).first()
    assert after.t == rows.agg(F.min("t")).first()[0]
    ends = simulate.simulate_episodes(spark, horizons=[5.0, 20.0], seed=4, **model)
    assert all(r.t < (5.0, 20.0)[r.path_id] for r in ends.collect())


def test_cascades_and_storage(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1,a.com\n2,b.org\n\nm1;1,0.5,2,0.5,1,1.0\nm2;2,0.5,2,2.0\n")
    sites, c = cascades.read_cascades(spark, str(tmp_path / "c.txt"))
    assert sites.count() == 2 and c.count() == 5
    assert sorted((r.site_id, r.t) for r in cascades.flatten_cascades(c).collect()) == [("1", 0.5), ("1", 1.0), ("2", 2.0)]
    jittered = cascades.flatten_cascades(c, keep_first_only=False, delay=0.1)
    assert jittered.count() == 4 and jittered.select("t").distinct().count() == 4
    assert sorted(r.t for r in cascades.rescale_times(c, 2.0, 1.0, 3.0).collect()) == [0.0, 0.0, 0.0, 1.0]
    e = frame(spark, ORDERING)
    store.write_paths(e, str(tmp_path / "paths"))
    assert store.read_paths(spark, str(tmp_path / "paths")).count() == 20
    store.write_model(spark, {"mu": [1.0]}, str(tmp_path / "model"))
    assert store.read_model(spark, str(tmp_path / "model")) == {"mu": [1.0]}


def test_empty_path_and_edges(spark):
    e = frame(spark, [[], []])
    assert paths.kappa(e, 2).count() == paths.histogram(e, 1.0, 3).count() == sums.pairs(e).count() == 0
    e = frame(spark, [[0.0, 1.0, 3.0]])
    assert [r.n for r in paths.histogram(e, 1.0, 3).orderBy("bin").collect()] == [1, 1, 1]
    assert paths.truncate(e, 3.0).count() == 2


def test_online_intensity_equals_the_scan(spark, tmp_path):
    e = frame(spark, ORDERING)
    mu, w, b = [0.1, 0.2], [[0.2, 0.3], [0.1, 0.2]], [[5.0, 1.0], [0.7, 2.0]]
    for k, (low, high) in enumerate([(0.0, 1.8), (1.8, 2.0), (2.0, 9.0)]):
        e.where((F.col("t") >= low) & (F.col("t") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    q = online.online_intensity(stream, mu, w, b).writeStream.format("memory").queryName("online").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.m: r.intensity for r in spark.sql("select * from online").collect()}
    want = {r.m: r.intensity for r in expscan.exp_intensity(e, mu, w, b).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_look_ups_are_made_on_every_path(spark, tmp_path):
    """More paths than the constant probe has, one of them hot, against brute force."""
    import datetime

    from pulsegrid.plans import catalog

    origin = datetime.datetime(2024, 1, 1)
    users = [u for u in range(5, 45) for _ in range(400 if u == 33 else 3)]
    rows = [(i, origin + datetime.timedelta(seconds=(i * 7919) % 2_592_000), u, catalog.TYPES[i % 5], float(i)) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    later = {x.query_id: x.mark for x in catalog.QUERIES["next_event_paths"](spark, str(tmp_path)).collect()}
    counts = {x.query_id: x.n_0 + x.n_1 + x.n_2 + x.n_3 + x.n_4 for x in catalog.QUERIES["counting_process_paths"](spark, str(tmp_path)).collect()}
    assert set(later) == set(counts) == {u * 24 + i for u in range(5, 45) for i in range(24)}
    for q in later:
        at = q % 24 * 30 + q // 24 % 30
        own = [((ts - origin).total_seconds() / 3600, v) for _, ts, u, _, v in rows if u == q // 24]
        assert later[q] == min((x for x in own if x[0] > at), default=(0, None))[1] and counts[q] == sum(t <= at for t, _ in own)
