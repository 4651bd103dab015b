"""Scans of any decays, marked and episodic losses, banded fits, power laws, Poisson fits and samples against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import baselines, impacts, kernels
from pulsegrid.operators import banded, blocks, expscan, fit, losses, marked, poisson, powerscan, sampling, simulate, strata, sums

SCHEMA = "path_id long, event_id long, dim int, t double, mark double"


def events_of(spark, seed=1, paths=3, n=60, horizon=50.0, dims=2, digits=None):
    r = np.random.default_rng(seed)
    rows = []
    for p in range(paths):
        t = np.sort(r.uniform(0, horizon, n))
        t = np.round(t, digits) if digits is not None else t
        rows += [(p, p * 1000 + i, int(r.integers(dims)), float(x), float(r.uniform(0.1, 2))) for i, x in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("width", [None, 7.0, 0.9, 500.0])
def test_sums_of_unlike_decays_equal_pair_sums(spark, width):
    """Ties, decays from none to fast, blocks of any width, and times far from 0."""
    frame, rows = events_of(spark, n=250, horizon=60.0, digits=1)
    frame = frame.withColumn("t", F.col("t") + 1000.0)
    betas = [100.0, 1.0, 0.9, 0.02, 0.001, 0.0]
    got = {r["event_id"]: r for r in expscan.exp_sums(frame, [(b, F.col("mark")) for b in betas], [f"s{i}" for i in range(len(betas))], width).collect()}
    for p in range(3):
        own = [r for r in rows if r[0] == p]
        t, m = np.array([r[3] for r in own]), np.array([r[4] for r in own])
        dt = t[:, None] - t[None, :]
        for i, b in enumerate(betas):
            want = np.where(dt > 0, np.exp(-b * np.maximum(dt, 0)) * m, 0.0).sum(axis=1)
            assert np.allclose([got[r[1]][f"s{i}"] for r in own], want, rtol=1e-9, atol=1e-9 * max(1.0, want.max()))


def test_decays_far_apart_share_two_shuffles():
    assert len(expscan.decay_groups([100.0, 0.001], 5.0)) == 2 and len(expscan.decay_groups([100.0, 0.001], 5.0, short=True)) == 1
    assert len(expscan.decay_groups([1.0, 1.0, 0.5, 0.01, 0.0], 5.0)) == 1
    for b in (1e-6, 0.01, 1.0, 30.0):
        k = expscan.blocks_in_span(b, 0.5)
        assert k >= 1 and (k == 1 or b * k * 0.5 <= 30.0001) and expscan.blocks_in_span(b, 0.5, 10.0) in (0, k)


@pytest.mark.parametrize("family", [impacts.LINEAR, impacts.EXPONENTIAL, impacts.POWER])
def test_marked_loss_and_gradient(spark, family):
    frame, _ = events_of(spark)
    beta, theta, omega = np.array([[0.7, 1.3], [2.0, 0.4]]), np.array([[0.2, 0.5], [0.1, 0.9]]), np.array([[0.3, 0.2], [0.1, 0.4]])
    level, slope, horizon = np.array([0.2, 0.3]), np.array([0.01, 0.002]), 60.0
    pick = lambda m, k, j: F.get(F.get(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m]), k), j)
    at = lambda v, k: F.get(F.array(*[F.lit(float(x)) for x in v]), k)
    kernel = lambda k, j: kernels.Exponential(pick(omega, k, j), pick(beta, k, j))
    line = lambda k: baselines.Linear(at(slope, k), at(level, k))
    k_of = lambda k, j, left, t: kernel(k, j).linear_k(left, t, at(slope, k), at(level, k))
    want = losses.marked_least_squares(frame, kernel, lambda k, t: line(k).mu(t), lambda k: line(k).mean_square(horizon), k_of, lambda k, j, x: family.value(pick(theta, k, j), x), 2, horizon, 3)
    got, g = marked.scan_sums(frame, beta, horizon, 3, family, theta).loss_and_gradient(level, slope, omega)
    assert got == pytest.approx([r["lse"] for r in want.orderBy("k").collect()])
    for name, which in (("beta", 0), ("theta", 1), ("omega", 2)):
        values = [beta.copy(), theta.copy(), omega.copy()]
        ends = []
        for sign in (1, -1):
            moved = [v.copy() for v in values]
            moved[which][1, 0] += sign * 1e-5
            ends.append(marked.scan_sums(frame, moved[0], horizon, 3, family, moved[1]).loss_and_gradient(level, slope, moved[2])[0][1])
        assert g[name][1, 0] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-7)


def test_marked_fit_finds_impact_and_decay(spark):
    """Events of a model whose marks double the offspring: the fit moves towards it, its log is a table and a fit goes on from it."""
    rows = simulate.simulate_hawkes(spark, paths=20, mu=np.array([0.4]), kernel=lambda k, j: kernels.Exponential(0.3, 1.5), mean=np.array([[0.3]]), horizon=150.0, seed=4, mark=lambda u: u, impact=lambda k, j, x: impacts.linear(x, 1.5))
    rows = rows.select("path_id", F.col("id").alias("event_id"), "dim", "t", "mark")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = marked.fit_marked(rows, np.array([[0.6]]), np.array([[0.1]]), impacts.LINEAR, horizon=150.0, paths=20, n_iter=12, rate=0.3)
    losses_of = [r["loss"] for r in got.log]
    assert losses_of[-1] < losses_of[0] and abs(got.beta[0, 0] - 1.5) < 0.6 and got.theta[0, 0] > 0.3 and abs(got.level[0] - 0.4) < 0.1
    log = marked.log_frame(spark, got.log)
    assert log.count() == 13
    beta, theta = marked.last_step(log, 1)
    again = marked.fit_marked(rows, beta, theta, impacts.LINEAR, horizon=150.0, paths=20, n_iter=0)
    assert again.lse == pytest.approx(got.lse)


def test_paths_with_horizons_of_their_own(spark):
    """Equal horizons give the plain fit; unlike ones the quadratic of the sums by hand; paths without events count."""
    frame, rows = events_of(spark, dims=1)
    beta = np.array([[0.9]])
    same = spark.createDataFrame([(p, 50.0) for p in range(3)], "path_id long, horizon double")
    plain, own = marked.fit_marked(frame, beta, horizon=50.0, paths=3, n_iter=0), marked.fit_marked(frame, beta, horizon=same, n_iter=0)
    assert own.level == pytest.approx(plain.level) and own.omega == pytest.approx(plain.omega) and own.lse == pytest.approx(plain.lse)
    assert plain.level == pytest.approx(fit.fit_fixed_decays(frame, beta, 50.0, 3)[0])
    ends = spark.createDataFrame([(0, 20.0), (1, 50.0), (2, 35.0), (9, 10.0)], "path_id long, horizon double")
    s = marked.scan_sums(frame, beta, ends)
    end_of = {0: 20.0, 1: 50.0, 2: 35.0}
    a = sum(1 - math.exp(-0.9 * (end_of[p] - t)) for p, _, _, t, _ in rows if t <= end_of[p])
    phi = sum(0.9 * math.exp(-0.9 * (t - u)) for p, _, _, t, _ in rows for q, _, _, u, _ in rows if p == q and u < t <= end_of[p])
    assert s.moments[0] == 115.0 and s.single["a"][0, 0] == pytest.approx(a) and s.paired["phi"][0, 0, 0] == pytest.approx(phi)
    assert marked.scan_sums(frame.limit(0), beta, ends).n.tolist() == [0.0]


def test_banded_pairs_are_all_pairs_within_reach(spark):
    frame, rows = events_of(spark, digits=0)
    got = sorted((r["m"], r["t"], round(r["dt"], 9)) for r in banded.banded_pairs(frame, 3.0).collect())
    assert got == sorted((a[1], a[3], a[3] - b[3]) for a in rows for b in rows if a[0] == b[0] and 0 < a[3] - b[3] <= 3.0)
    with pytest.raises(ValueError):
        banded.reach_of([kernels.Exponential(1.0, 1.0)])


def test_shapes_of_short_kernels(spark):
    """Terms from banded pairs equal those from all pairs, and rounds lower the loss towards the shape of the data."""
    frame, _ = events_of(spark, horizon=40.0)
    for kind, shape in ((kernels.Gaussian, (0.5, 2.0)), (kernels.Uniform, (2.0, 1.0)), (kernels.Rayleigh, (0.8,))):
        ups = (lambda x, y, t, s: kernels.upsilon_by_quadrature(x, y, t, s, 400)) if kind is kernels.Rayleigh else None
        k = kind(1.0, *shape)
        terms = banded.shape_terms(frame, kind, [shape], 2, 40.0, 3)[0]
        if ups is None:
            for (q, c), (q2, c2) in zip(terms, losses.basis_terms(frame, lambda p, k=k: lambda a, b: k, 1, 2, 40.0, 3), strict=True):
                assert q == pytest.approx(q2, abs=1e-9) and c == pytest.approx(c2, abs=1e-9)
        else:
            phi = sums.phi_sums(sums.pairs(frame), lambda a, b, k=k: k).where("k = 0 and j = 1").first()["phi"]
            assert terms[0][1][2] * 120.0 == pytest.approx(phi)
    rows = simulate.simulate_hawkes(spark, paths=30, mu=np.array([0.3]), kernel=lambda k, j: kernels.Gaussian(0.5, 0.4, 3.0), mean=np.array([[0.5]]), horizon=100.0, seed=2)
    rows = rows.select("path_id", F.col("id").alias("event_id"), "dim", "t", F.lit(1.0).alias("mark"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    grid = [(1.0, 1.0), (1.0, 2.5), (1.0, 4.0)]
    start = banded.fit_shapes(rows, kernels.Gaussian, grid, 1, 100.0, 30)
    end = banded.fit_shapes(rows, kernels.Gaussian, grid, 1, 100.0, 30, rounds=4, steps=(0.8, 1.0), lows=(0.05, 0.0))
    assert end.lse[0] < start.lse[0] and end.tried > start.tried and abs(end.shape[0][1] - 3.0) < 0.3 and abs(end.omega[0, 0] - 0.5) < 0.15


def test_uniform_upsilon_and_reaches(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    x, y = kernels.Uniform(0.8, 2.0, 0.5), kernels.Uniform(0.5, 3.0, 1.0)
    for t, s in ((10.0, 0.7), (1.0, 0.0), (0.2, 3.0), (10.0, 9.0)):
        n = 4000
        u = (np.arange(n) + 0.5) * t / n
        want = float(np.sum(np.where((u >= 0.5) & (u < 2.5), 0.4, 0) * np.where((u + s >= 1.0) & (u + s < 4.0), 0.5 / 3, 0)) * t / n)
        assert one(x.upsilon(y, t, s)) == pytest.approx(want, abs=2e-3)
    # a narrow kernel on a long horizon stands between no nodes
    g = kernels.Gaussian(1.0, 0.5, 3.0)
    assert one(kernels.upsilon_by_quadrature(g, g, 720.0, 0.3)) == pytest.approx(one(g.upsilon(g, 720.0, 0.3)), rel=1e-6)
    assert one(kernels.upsilon_by_quadrature(g, g, F.lit(720.0), F.lit(30.0))) == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("alpha, beta", [(1.5, 0.7), (0.3, 5.0), (4.0, 0.05)])
def test_power_laws_are_within_their_bound(alpha, beta):
    for tolerance in (1e-6, 1e-11):
        law = powerscan.power_law_sum(alpha, beta, tolerance)
        assert law.relative <= tolerance and law.absolute <= tolerance * alpha * beta * 1.01
        for t in (0.0, 0.01, 1.0, 30.0, 720.0, 1e5):
            exact = alpha * beta * (1 + beta * t) ** (-1 - alpha)
            assert abs(law.density(t) - exact) <= law.relative * exact + law.absolute + 1e-14
    assert law.mass(50.0) == pytest.approx(1 - (1 + beta * 50.0) ** -alpha, abs=1e-7)


def test_power_law_scan_equals_pairs(spark):
    frame, _ = events_of(spark, digits=1)
    mu, gain = [0.1, 0.2], [0.3, 0.4]
    at = lambda v, k: F.get(F.array(*[F.lit(x) for x in v]), k)
    kernel = lambda k, j: kernels.PowerLaw(at(gain, k), 1.5, 0.7)
    want = {r["m"]: r["intensity"] for r in sums.intensity(frame, kernel, lambda k, t: at(mu, k), lambda k, j, x: 1 + x).collect()}
    got = {r["m"]: r["intensity"] for r in powerscan.power_law_intensity(frame, mu, gain, 1.5, 0.7, 1 + F.col("mark")).collect()}
    assert got == pytest.approx(want, abs=1e-8)
    want = {r["m"]: r["compensator"] for r in sums.compensators(frame, kernel, lambda k, t: at(mu, k) * t, lambda k, j, x: 1 + x).collect()}
    got = {r["m"]: r["compensator"] for r in powerscan.power_law_compensators(frame, mu, gain, 1.5, 0.7, 1 + F.col("mark")).collect()}
    assert got == pytest.approx(want, abs=1e-7)


def test_cosine_fit_finds_the_frequency(spark):
    """A rate 1 + 0.8 cos(0.5 t + 0.4), thinned: a rough grid, then Newton's steps."""
    r = np.random.default_rng(3)
    t = r.uniform(0, 400, 8000)
    t = t[r.uniform(0, 1.8, 8000) < 1 + 0.8 * np.cos(0.5 * t + 0.4)]
    frame = spark.createDataFrame([(0, i, 0, float(x), 1.0) for i, x in enumerate(t)], SCHEMA)
    rough = poisson.fit_cosine(frame, [0.3, 0.495, 0.7], 400.0)[0]
    fine = poisson.fit_cosine(frame, [0.3, 0.495, 0.7], 400.0, newton=6)[0]
    assert rough.frequency == 0.495 and fine.lse < rough.lse and fine.frequency == pytest.approx(0.5, abs=5e-4)
    assert fine.alpha / fine.level == pytest.approx(0.8, abs=0.08) and fine.phase == pytest.approx(0.4, abs=0.15) and fine.delta == pytest.approx(fine.level - fine.alpha)
    assert poisson.fit_cosine(frame.limit(0), [0.3], 400.0) == []


def test_pieces_have_the_best_levels(spark):
    frame, rows = events_of(spark)
    got = poisson.fit_pieces(frame, [0.0, 10.0, 30.0, 50.0], 3, 3).collect()
    assert len(got) == 9
    for x in got:
        low, high = [(0, 10), (10, 30), (30, 50)][x["piece"]]
        n = sum(1 for r in rows if r[2] == x["dim"] and low <= r[3] < high)
        assert x["level"] == pytest.approx(n / (3 * (high - low))) and (n or x["loglik"] == 0)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 1025])
def test_places_are_permuted(spark, n):
    got = [[r[0] for r in spark.range(n).select(sampling.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(seed).cast("long"))).collect()] for seed in (1, 2)]
    assert all(sorted(x) == list(range(n)) for x in got) and (n < 64 or got[0] != got[1])


def test_samples_and_their_gradients(spark):
    frame, rows = events_of(spark, n=90, digits=1)
    beta, theta, omega, level = np.array([[0.7, 1.3], [2.0, 0.4]]), np.array([[0.2, 0.5], [0.1, 0.9]]), np.array([[0.3, 0.2], [0.1, 0.4]]), np.array([0.2, 0.3])
    places = sampling.place_pairs(frame, 2, [(1, 1), (2, 2), (3, 9), (10, 1 << 30)])
    pairs = sums.pairs(frame)
    assert sum(places.sizes.values()) == pairs.count()
    drawn = places.draw({0: 7, 1: 10**9, 3: 100}, 5)
    assert {r["stratum"]: r["count"] for r in drawn.groupBy("stratum").count().collect()} == {0: 7, 1: places.sizes[1], 3: 100}
    assert drawn.select("path_id", "i", "m", "j", "h").distinct().count() == drawn.count() and drawn.where("dt <= 0").count() == 0
    _, exact = marked.scan_sums(frame, beta, 60.0, 3, impacts.LINEAR, theta).loss_and_gradient(level, np.zeros(2), omega)
    whole = sampling.sampled_gradient(places, dict(places.sizes), 5, level, omega, beta, 60.0, 3, None, impacts.LINEAR, theta)
    some = sampling.sampled_gradient(places, dict.fromkeys(places.sizes, 150), 5, level, omega, beta, 60.0, 3, None, impacts.LINEAR, theta)
    for name in ("level", "omega", "beta", "theta"):
        assert whole.value[name] == pytest.approx(exact[name], abs=1e-10)
        assert np.all(np.abs(some.value[name] - exact[name]) <= 5 * np.sqrt(some.variance[name]) + 1e-12)
    assert set(some.spread) == set(places.sizes)


def test_stochastic_fit_lowers_the_loss(spark):
    frame, _ = events_of(spark, n=60, dims=1)
    start = (np.array([0.4]), np.array([[0.8]]), np.array([[0.5]]))
    level, omega, beta, _, log = sampling.fit_sampled(frame, *start, 50.0, 3, budget=300, n_iter=8, solver=fit.Adam(fit.Schedule(0.1)), strata=strata.lag_strata(1 << 20, 3, 3))
    loss = lambda c, w, b: marked.scan_sums(frame, b, 50.0, 3).loss_and_gradient(c, np.zeros(1), w)[0][0]
    assert len(log) == 8 and loss(level, omega, beta) < loss(*start)


def test_single_sums_from_three_domains(spark):
    frame, _ = events_of(spark, n=200)
    value = 1 - F.exp(-0.3 * (50.0 - F.col("t")))
    places = sampling.place_singles(frame, [(1, 1), (2, 2), (3, 6), (7, 30), (31, 1 << 30)])
    exact = frame.agg(F.sum(value)).first()[0]
    got = sampling.estimated_sums(places, {"psi": value}, sampling.Domains(2, 2, 30, 60), single=True).first()
    assert got["size"] == 600 and got["drawn"] < 600 and abs(got["total"] - exact) <= 5 * math.sqrt(got["variance"])
    whole = sampling.estimated_sums(places, {"psi": value}, sampling.Domains(2, 2, 10**6, 10**6), single=True).first()
    assert whole["total"] == pytest.approx(exact) and whole["variance"] == pytest.approx(0.0) and whole["drawn"] == 600


def test_extent_and_logs(spark, tmp_path):
    frame, rows = events_of(spark)
    n, span = blocks.extent(frame)
    assert n == 60 and span == pytest.approx(max(max(r[3] for r in rows if r[0] == p) - min(r[3] for r in rows if r[0] == p) for p in range(3)))
    assert blocks.extent(frame.limit(0)) == (0, 0.0)


def test_schedules_and_clipping():
    assert [fit.Schedule().at(t) for t in (0, 10**6)] == [0.01, 0.01]
    assert [fit.Schedule(kind="exponential").at(t) for t in (0, 199, 200, 450, 10**5)] == pytest.approx([0.1, 0.1, 0.05, 0.025, 1e-3])
    assert [fit.Schedule(kind="linear").at(t) for t in (0, 10)] == pytest.approx([1.0, 0.5])
    assert fit.Schedule(kind="custom", custom=lambda t: 1 / (t + 1)).at(3) == 0.25
    with pytest.raises(ValueError):
        fit.Schedule(kind="custom")
    s = fit.Schedule(window=2, clip_factor=1.0, clip_offset=0.5)
    g = [np.array(x, float) for x in ([1, 9], [-2, 1], [100, -100], [100, 0])]
    assert [s.clipped(x).tolist() for x in g] == [[1, 9], [-2, 1], [2.5, -9.5], [3.0, 0.0]]


def test_free_decays_are_fitted_by_one_scan_a_step(spark):
    frame, _ = events_of(spark, n=80)
    b = np.full((2, 2), 1.2)
    mu, omega, beta, log = fit.fit_exponential(frame, b, 50.0, 3, n_iter=3)
    assert len(log) == 3 and log[0][1].tolist() == b.tolist()
    assert sum(fit.fit_fixed_decays(frame, beta, 50.0, 3)[2]) <= log[0][2] + 1e-12
