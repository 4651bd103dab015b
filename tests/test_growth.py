"""Steps whose rows must grow with the input and not with the square of a group, against plain counts."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.operators import banded, expscan, paths, sampling, simulate

EVENTS = "path_id long, event_id long, dim int, t double, mark double"


def tied_events(spark, n=600, times=12, paths=2, dims=3, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(p), i, int(k), float(t), float(x)) for i, (p, k, t, x) in enumerate(zip(rng.integers(0, paths, n), rng.integers(0, dims, n), rng.integers(0, times, n), rng.random(n)))]
    return rows, spark.createDataFrame(rows, EVENTS)


def test_banded_counts_are_those_of_the_pairs(spark):
    """As many pairs as single events make, in rows that the number of events at one time does not multiply."""
    rows, frame = tied_events(spark)
    got = banded.banded_counts(frame, 2.5).collect()
    want = Counter((a[0], a[2], b[2], a[3], a[3] - b[3]) for a in rows for b in rows if a[0] == b[0] and 0 < a[3] - b[3] <= 2.5)
    assert {(x.path_id, x.k, x.j, x.t, x.dt): x.n for x in got} == want
    assert len(got) == len(want) <= 2 * 12 * 2 * 9
    crowd = spark.range(200_000).select(F.lit(1).cast("long").alias("path_id"), F.col("id").alias("event_id"), F.lit(0).alias("dim"), (F.col("id") % 2).cast("double").alias("t"), F.lit(1.0).alias("mark"))
    assert [(x.dt, x.n) for x in banded.banded_counts(crowd, 1.0).collect()] == [(1.0, 100_000**2)]


def test_covariances_of_a_path_need_no_join_of_its_bins(spark):
    rows, frame = tied_events(spark)
    out = paths.empirical_covariance(frame.withColumn("t", F.col("t") - 1), 2.0, 5, 7)  # some before the first bin, some past the last, one lag too long
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    n = np.zeros((2, 3, 5))
    for p, _, k, t, _ in rows:
        if 0 <= t - 1 <= 10:
            n[p, k, min(int((t - 1) // 2), 4)] += 1
    want = {(p, i, j, lag): (np.mean(n[p, j, : 5 - lag] * n[p, i, lag:]) - n[p, j, : 5 - lag].mean() * n[p, i, lag:].mean()) / 2 for p in range(2) for i in range(3) for j in range(3) for lag in range(5)}
    got = {(x.path_id, x.i, x.j, x.lag): x.covariance for x in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_kappa_totals_are_sums_of_kappa(spark):
    _, frame = tied_events(spark)
    k = paths.kappa(frame, 3).groupBy("path_id", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("kappa").alias("s")).collect()
    got = {(x.path_id, x.i): x for x in paths.kappa_totals(frame, 3).collect()}
    assert len(k) == 18 and all((got[x.path_id, x.i].n, got[x.path_id, x.i][f"kappa_{x.j}"]) == (x.n, x.s) for x in k)


def test_poisson_draws_are_the_quantiles_of_their_uniforms(spark):
    """Small numbers are told by comparisons, others by the long sum; both are the law's quantile, and large means are split."""
    at = spark.range(4000).withColumn("mean", F.col("id") % 40 / 5 + 0.02)
    rows = at.select("mean", simulate.uniform(3, F.col("id"), F.lit(1)).alias("u"), simulate.poisson(F.col("mean"), 3, F.col("id")).alias("n")).collect()
    for x in rows:
        p = c = math.exp(-x.mean)
        n = 0
        while c < x.u and n < 80:
            n += 1
            p = p * x.mean / n
            c += p
        assert x.n == n
    many = spark.range(2000).select(simulate.poisson(F.lit(50.0), 3, F.col("id")).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(many[0] - 50) < 1 and abs(many[1] - 50) < 8
    whole = spark.range(1).select(simulate.poisson(F.lit(0.1), 3, F.col("id")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in whole  # a draw of a small mean is a comparison first


def test_sums_of_short_paths_follow_from_one_another(spark):
    """Ties, several batches within a path, decays of all sizes and none, null marks: as plain sums, with nothing but the events shuffled."""
    rows, frame = tied_events(spark, 400, 60, 3)
    frame = frame.withColumn("mark", F.when(F.col("event_id") % 7 > 0, F.col("mark")))
    betas, names = [0.7, 0.0, 300.0, 1e-4, 0.7], list("abcde")
    one = F.lit(1.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        out = expscan.exp_sums(frame, [(b, F.col("mark") if n == "e" else one) for b, n in zip(betas, names)], names)
        got = {x.event_id: x for x in out.collect()}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in plan and "Join" not in plan and len(got) == 400
    for p, e, _, t, _ in rows:
        for b, n in zip(betas, names):
            want = sum(math.exp(-b * (t - s)) * (1.0 if n != "e" else x if i % 7 else 0.0) for q, i, _, s, x in rows if q == p and s < t)
            assert abs(got[e][n] - want) < 1e-9 * max(1, want)
    assert expscan.exp_sums(frame.limit(0), [(1.0, one)], ["a"]).count() == 0


def test_whole_strata_are_taken_from_the_rows(spark):
    """A stratum that is drawn whole is each of its pairs once; no list of its places is made."""
    _, frame = tied_events(spark, 200, 40)
    places = sampling.place_pairs(frame, 3, [(1, 1), (2, 3), (4, 1000)])
    allocation = {0: places.sizes[0], 1: 25, 2: places.sizes[2] + 5}
    got = places.draw(allocation, 3).collect()
    found = Counter(x.stratum for x in got)
    assert found == {0: places.sizes[0], 1: 25, 2: places.sizes[2]}
    assert len({(x.path_id, x.i, x.m, x.j, x.h) for x in got}) == len(got) and all(x.dt > 0 for x in got)
    whole = places.indices({0: places.sizes[0]}, 3)
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString() and whole.count() == places.sizes[0]
    assert places.indices({}, 3).count() == 0
    k = paths.kappa(frame, 3).where("kappa >= 0").count()
    assert whole.where("h = 1 and n >= 0").count() == k


def test_kepler_is_undone_over_whole_arrays(spark):
    """By series and by bisection alike, nulls stay null, and no row walks a list of terms of its own."""
    y = F.when(F.col("id") % 5 > 0, F.col("id") / 3 - 6)
    out = spark.range(60).select(y.alias("y"), scalars.inverse_kepler_series(y, 0.6).alias("a"), scalars.inverse_kepler(y, F.lit(0.6), 52).alias("b"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan
    for x in out.collect():
        assert (x.y is None) == (x.a is None) == (x.b is None)
        assert x.y is None or abs(x.a - x.b) < 1e-9 and abs(x.b - 0.6 * math.sin(x.b) - x.y) < 1e-12
