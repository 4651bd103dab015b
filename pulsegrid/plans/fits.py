"""Registered fits and estimates that return numbers, and the SQL that finds the same numbers from pair sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import baselines, impacts, kernels, marks, scalars, tabulated
from pulsegrid.operators import banded, expscan, fit, marked, poisson, powerscan, sampling, simulate, strata, sums
from pulsegrid.plans.catalog import AT, BETA, BETA_M, DIMS, EV, HORIZON, LONG, MU_V, OMEGA, OMEGA_M, ORACLES, PAIR, at_times, events_of, long_paths, query, r

col = F.col
THETA = "(0.1 * (1 + (k + j) % 3))"
THETA_M = [[0.1 * (1 + (k + j) % 3) for j in range(DIMS)] for k in range(DIMS)]
STEPS = 60

PAR = f"par0 AS MATERIALIZED (SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, {BETA} AS b, {THETA} AS p FROM range(5) AS x(k), range(5) AS y(j))"
SINGLE_SQL = {
    "a": "u * (1 - exp(-b * l))", "da": "u * l * exp(-b * l)", "va": "v * (1 - exp(-b * l))", "own": "u * u * b / 2 * (1 - exp(-2 * b * l))",
    "down": "u * u * ((1 - exp(-2 * b * l)) / 2 + b * l * exp(-2 * b * l))", "vown": "u * v * b * (1 - exp(-2 * b * l))",
}
PHI_SQL = {"phi": "b * s * u", "dphi": "(1 - b * dt) * s * u", "vphi": "b * s * v"}
UPS_SQL = {
    "ups": "g * m * ui * s * u", "later": "ui * u * s * (pow(b / (bi + b), 2) * m + g * l * (1 - m))",
    "earlier": "ui * u * s * (pow(bi / (bi + b), 2) * m + g * l * (1 - m) - g * m * dt)", "vlater": "g * m * vi * s * u", "vearlier": "g * m * ui * s * v",
}


def sums_sql(n: int, u: str = "1", v: str = "0", ui: str = "1", vi: str = "0", left: str = "720.0 - t") -> str:
    """The CTEs s{n}, f{n}, u{n}: sums over events and pairs at the parameters of par{n}; u, v are an impact and its derivative, ui, vi those of the later event."""
    add = lambda d: ", ".join(f"sum({x}) AS {c}" for c, x in d.items())
    return f"""s{n} AS MATERIALIZED (SELECT k, j, {add(SINGLE_SQL)} FROM (SELECT par.k, par.j, b, {u} AS u, {v} AS v, {left} AS l FROM ev JOIN par{n} par ON par.j = ev.dim) GROUP BY k, j),
f{n} AS MATERIALIZED (SELECT k, j, {add(PHI_SQL)} FROM (SELECT par.k, par.j, b, dt, exp(-b * dt) AS s, {u} AS u, {v} AS v FROM pr JOIN par{n} par ON par.k = pr.k AND par.j = pr.j) GROUP BY k, j),
u{n} AS MATERIALIZED (SELECT k, i, j, {add(UPS_SQL)} FROM (SELECT q.k, q.j AS i, par.j, q.b AS bi, par.b AS b, q.b * par.b / (q.b + par.b) AS g, 1 - exp(-(q.b + par.b) * ({left})) AS m, {left} AS l, exp(-par.b * dt) AS s, dt,
  {u.replace("p *", "par.p *")} AS u, {v} AS v, {ui.replace("p *", "q.p *")} AS ui, {vi} AS vi FROM pr JOIN par{n} par ON par.j = pr.j JOIN par{n} q ON q.k = par.k AND q.j = pr.k) GROUP BY k, i, j)"""


def solve_sql(n: int, total: str, low: float = 1e-10, dims: int = 5, steps: int = STEPS, counts: str = "SELECT dim AS k, count(*) AS n FROM ev GROUP BY dim") -> str:
    """The CTEs up to x{n} (k, x0, x1 ...): the minimum of the bounded quadratic over (level, omega_k0, omega_k1 ...) by cyclic coordinate steps."""
    m = dims + 1
    cells = f"""e{n} AS MATERIALIZED (SELECT k, r, s, sum(x) / ({total}) AS x FROM (
  SELECT k, 0 AS r, j + 1 AS s, a AS x FROM s{n} UNION ALL SELECT k, j + 1, 0, a FROM s{n} UNION ALL SELECT k, j + 1, j + 1, own FROM s{n}
  UNION ALL SELECT k, i + 1, j + 1, ups FROM u{n} UNION ALL SELECT k, j + 1, i + 1, ups FROM u{n}
  UNION ALL SELECT k, j + 1, -1, phi FROM f{n} UNION ALL SELECT k, 0, -1, n FROM ({counts})) GROUP BY k, r, s)"""
    wide = [f"coalesce(max(x) FILTER (r = {a} AND s = {b}), {1 if a == b == 0 else 0}) AS q{a}_{b}" for a in range(m) for b in range(m)]
    wide += [f"coalesce(max(x) FILTER (r = {a} AND s = -1), 0) AS c{a}" for a in range(m)]
    step = []
    for a in range(m):
        rest = " - ".join(f"q{a}_{b} * {'y' if b < a else 'x'}{b}" for b in range(m) if b != a)
        step.append(f"CASE WHEN q{a}_{a} > 0 THEN greatest({low if a == 0 else 0}, (c{a} - {rest}) / q{a}_{a}) ELSE x{a} END AS y{a}")
    return f"""{cells}, w{n} AS MATERIALIZED (SELECT k, {", ".join(wide)} FROM e{n} GROUP BY k),
it{n} AS (SELECT 0 AS n, k, {", ".join(f"{low if a == 0 else 0.0}::DOUBLE AS x{a}" for a in range(m))} FROM w{n}
  UNION ALL SELECT n + 1, k, {", ".join(f"y{a}" for a in range(m))} FROM (SELECT n, k, {", ".join(step)} FROM it{n} JOIN w{n} USING (k) WHERE n < {steps})),
x{n} AS MATERIALIZED (SELECT k, {", ".join(f"x{a}" for a in range(m))} FROM it{n} WHERE n = {steps})"""


OMEGA_OF = "list_value(x1, x2, x3, x4, x5)"


def fitted_sql(n: int) -> str:
    return f"SELECT 'level' AS name, k, -1 AS j, round(x0, 6) AS value FROM x{n} UNION ALL SELECT 'omega', k, CAST(j AS INT), round({OMEGA_OF}[j + 1], 6) FROM x{n}, range(5) AS g(j)"


def gradient_sql(n: int, total: str) -> str:
    """The CTE g{n} (k, j, gb, gp): the loss's derivatives by beta and theta at the best level and omega."""
    return f"""o{n} AS MATERIALIZED (SELECT k, CAST(j AS INT) AS j, x0 AS c, {OMEGA_OF}[j + 1] AS w FROM x{n}, range(5) AS g(j)),
g{n} AS MATERIALIZED (SELECT k, j, sum(gb) / ({total}) AS gb, sum(gp) / ({total}) AS gp FROM (
  SELECT k, j, 2 * w * c * da + w * w * down AS gb, 2 * w * c * va + w * w * vown AS gp FROM s{n} JOIN o{n} USING (k, j)
  UNION ALL SELECT k, j, -2 * w * dphi, -2 * w * vphi FROM f{n} JOIN o{n} USING (k, j)
  UNION ALL SELECT u.k, u.i, 2 * a.w * b.w * later, 2 * a.w * b.w * vlater FROM u{n} u JOIN o{n} a ON a.k = u.k AND a.j = u.i JOIN o{n} b ON b.k = u.k AND b.j = u.j
  UNION ALL SELECT u.k, u.j, 2 * a.w * b.w * earlier, 2 * a.w * b.w * vearlier FROM u{n} u JOIN o{n} a ON a.k = u.k AND a.j = u.i JOIN o{n} b ON b.k = u.k AND b.j = u.j) GROUP BY k, j)"""


def fit_rows(spark, level, omega, **more):
    """(name, k, j, value) of fitted numbers, rounded."""
    rows = [("level", k, -1, float(level[k])) for k in range(len(level))]
    for name, m in {"omega": omega, **more}.items():
        rows += [(name, k, j, float(m[k, j])) for k in range(len(level)) for j in range(len(level))]
    return spark.createDataFrame(rows, "name string, k int, j int, value double").withColumn("value", r("value", 6))


TOTAL = "(SELECT CAST(count(DISTINCT path_id) AS DOUBLE) FROM ev) * 720.0"


@query(f"WITH RECURSIVE {EV}, {PAIR}, {PAR}, {sums_sql(0)}, {solve_sql(0, TOTAL)} {fitted_sql(0)}")
def hawkes_fit(spark, d):
    """The least-squares fit with fixed decays: (mu, omega) of all dimensions, from one scan."""
    e = events_of(spark, d)
    level, omega, _ = fit.fit_fixed_decays(e, np.array(BETA_M), HORIZON, e.select("path_id").distinct().count())
    return fit_rows(spark, level, omega)


ENDS = "en AS MATERIALIZED (SELECT path_id, max(t) AS h FROM ev GROUP BY path_id)"
EV_ENDS = EV.replace("ev AS (", "ev0 AS (") + ", ends AS MATERIALIZED (SELECT path_id, max(t) AS h FROM ev0 GROUP BY path_id), ev AS MATERIALIZED (SELECT ev0.*, h - t AS left_over FROM ev0 JOIN ends USING (path_id))"
PAIR_ENDS = PAIR.replace("a.mark AS mark_m", "a.mark AS mark_m, a.left_over")


@query(f"WITH RECURSIVE {EV_ENDS}, {PAIR_ENDS}, {PAR}, {sums_sql(0, left='left_over')}, {solve_sql(0, '(SELECT sum(h) FROM ends)')} {fitted_sql(0)}")
def hawkes_fit_episodes(spark, d):
    """The same over episodes with horizons of their own: each path ends with its last event."""
    e = events_of(spark, d)
    ends = e.groupBy("path_id").agg(F.max("t").alias("horizon"))
    got = marked.fit_marked(e, np.array(BETA_M), horizon=ends, n_iter=0)
    return fit_rows(spark, got.level, got.omega)


RATE, MARK = 100_000.0, "mark / 100"
U, V = f"(1 + p * ({MARK}))", f"({MARK})"
UI, VI = "(1 + p * (mark_m / 100))", "(mark_m / 100)"


def _par_after(n: int) -> str:
    """The parameters after a gradient step on log beta and theta."""
    return f"par{n + 1} AS MATERIALIZED (SELECT k, j, b * exp(-{RATE} * gb * b) AS b, greatest(p - {RATE} * gp, 0) AS p FROM par{n} JOIN g{n} USING (k, j))"


MARKED_CTES = f"{EV}, {PAIR}, {PAR}, {sums_sql(0, U, V, UI, VI)}, {solve_sql(0, TOTAL)}, {gradient_sql(0, TOTAL)}"
FIT_MARKED_CTES = f"{MARKED_CTES}, {_par_after(0)}, {sums_sql(1, U, V, UI, VI)}, {solve_sql(1, TOTAL)}, {gradient_sql(1, TOTAL)}, {_par_after(1)}, {sums_sql(2, U, V, UI, VI)}, {solve_sql(2, TOTAL)}"


def marked_events(spark, d):
    return events_of(spark, d).withColumn("mark", col("mark") / 100)


@query(f"WITH RECURSIVE {MARKED_CTES} SELECT 'beta' AS name, k, j, round(gb * 1e6, 5) AS value FROM g0 UNION ALL SELECT 'theta', k, j, round(gp * 1e6, 5) FROM g0")
def lse_gradient_marked(spark, d):
    """The loss's derivatives by decays and impact parameters at the best level and omega, times 10^6: one scan for quadratic and gradient."""
    e = marked_events(spark, d)
    s = marked.scan_sums(e, np.array(BETA_M), HORIZON, e.select("path_id").distinct().count(), impacts.LINEAR, np.array(THETA_M))
    _, g = s.loss_and_gradient(*marked.best_linear(s)[:3])
    rows = [(name, k, j, float(g[name][k, j])) for name in ("beta", "theta") for k in range(DIMS) for j in range(DIMS)]
    return spark.createDataFrame(rows, "name string, k int, j int, value double").withColumn("value", r(col("value") * 1e6, 5))


@query(f"WITH RECURSIVE {FIT_MARKED_CTES} {fitted_sql(2)} UNION ALL SELECT 'beta', k, j, round(b, 6) FROM par2 UNION ALL SELECT 'theta', k, j, round(p, 6) FROM par2")
def fit_marked(spark, d):
    """Two outer steps of the marked fit from the given start, each with the exact inner solution: level, omega, beta and theta."""
    e = marked_events(spark, d)
    n = e.select("path_id").distinct().count()
    got = marked.fit_marked(e, np.array(BETA_M), np.array(THETA_M), impacts.LINEAR, horizon=HORIZON, paths=n, n_iter=2, solver=fit.Momentum(fit.Schedule(RATE), keep=0.0))
    return fit_rows(spark, got.level, got.omega, beta=got.beta, theta=got.theta)


SHAPES = [(0.5, 1.0), (0.5, 3.0), (0.5, 6.0), (1.0, 1.0), (1.0, 3.0), (1.0, 6.0), (2.0, 1.0), (2.0, 3.0), (2.0, 6.0)]


def normal_sql(z: str) -> str:
    """The normal distribution function of an SQL expression, by the trapezoidal sum for erfc with its residue, whose terms fall with exp(-n^2 / 4)."""
    y = f"(abs({z}) / sqrt(2.0))"
    terms = " + ".join(f"{float(np.exp(-n * n / 4))!r} / ({n * n / 4} + {y} * {y})" for n in range(1, 13))
    half = f"(0.5 * (exp(-{y} * {y}) * {y} / (2 * pi()) * (1 / ({y} * {y}) + 2 * ({terms})) + CASE WHEN {y} < 6 THEN 2 / (1 - exp(4 * pi() * {y})) ELSE 0 END))"
    return f"(CASE WHEN abs({z}) < 1e-7 THEN 0.5 WHEN {z} < 0 THEN {half} ELSE 1 - {half} END)"


SHAPE_ROWS = ", ".join(f"({g}, {b}::DOUBLE, {d}::DOUBLE)" for g, (b, d) in enumerate(SHAPES))
GAUSS_SQL = f"""sh(g, b, d) AS (VALUES {SHAPE_ROWS}),
e0 AS (SELECT g, dim AS j, b, d, 720.0 - t AS l FROM ev, sh), e1 AS (SELECT *, (l - d) / b AS z1, -d / b AS z2, sqrt(2.0) * (l - d) / b AS z3, -sqrt(2.0) * d / b AS z4 FROM e0),
s9 AS MATERIALIZED (SELECT g * 5 + kk AS k, j, a, own FROM (SELECT g, j, sum({normal_sql("z1")} - {normal_sql("z2")}) AS a, sum(({normal_sql("z3")} - {normal_sql("z4")}) / (2 * b * sqrt(pi()))) AS own FROM e1 GROUP BY g, j), range(5) AS x(kk)),
p1 AS (SELECT g, k, j, b, d, dt, sqrt(2.0) * (720.0 - t - d + dt / 2) / b AS z1, -sqrt(2.0) * (d - dt / 2) / b AS z2 FROM pr, sh WHERE dt <= 24.0),
q1 AS MATERIALIZED (SELECT g, k AS i, j, sum(exp(-0.5 * pow((dt - d) / b, 2)) / (b * sqrt(2 * pi()))) AS phi, sum(exp(-dt * dt / (4 * b * b)) / (2 * b * sqrt(pi())) * ({normal_sql("z1")} - {normal_sql("z2")})) AS ups FROM p1 GROUP BY g, k, j),
f9 AS (SELECT g * 5 + i AS k, j, phi FROM q1), u9 AS (SELECT g * 5 + kk AS k, i, j, ups FROM q1, range(5) AS x(kk))"""
GAUSS_COUNTS = "SELECT g * 5 + dim AS k, count(*) AS n FROM ev, sh GROUP BY g, dim"
GAUSS_LOSS = " + ".join([f"q{a}_{b} * x{a} * x{b}" for a in range(6) for b in range(6)] + [f"-2 * c{a} * x{a}" for a in range(6)])


@query(f"""WITH RECURSIVE {EV}, {PAIR}, {GAUSS_SQL}, {solve_sql(9, TOTAL, counts=GAUSS_COUNTS)}, l9 AS (SELECT x9.*, {GAUSS_LOSS} AS lse FROM x9 JOIN w9 USING (k)),
b9 AS (SELECT *, k % 5 AS kk FROM l9 JOIN sh ON sh.g = k // 5 QUALIFY row_number() OVER (PARTITION BY k % 5 ORDER BY lse, k) = 1)
SELECT CAST(kk AS INT) AS k, b AS beta, d AS delta, round(x0, 6) AS level, round(x1, 6) AS omega_0, round(x2, 6) AS omega_1, round(x3, 6) AS omega_2, round(x4, 6) AS omega_3, round(x5, 6) AS omega_4, round(lse, 8) AS lse FROM b9""")
def fit_gaussian(spark, d):
    """Gaussian kernels with free shapes: the best of a grid for each receiver, its level and weights, from the pairs within reach alone."""
    e = events_of(spark, d)
    got = banded.fit_shapes(e, kernels.Gaussian, SHAPES, DIMS, HORIZON, e.select("path_id").distinct().count())
    rows = [(k, *got.shape[k], float(got.level[k]), *map(float, got.omega[k]), float(got.lse[k])) for k in range(DIMS)]
    out = spark.createDataFrame(rows, "k int, beta double, delta double, level double, " + ", ".join(f"omega_{j} double" for j in range(DIMS)) + ", lse double")
    return out.select("k", "beta", "delta", r("level", 6).alias("level"), *[r(f"omega_{j}", 6).alias(f"omega_{j}") for j in range(DIMS)], r("lse").alias("lse"))


@query(f"""WITH {LONG}, c AS (SELECT path_id, dim, t, count(*) AS n FROM li GROUP BY ALL)
SELECT a.path_id, CAST(a.dim AS INT) AS k, CAST(b.dim AS INT) AS j, CAST(sum(a.n * b.n) AS BIGINT) AS n, round(sum(a.n * b.n * (CASE WHEN a.t - b.t BETWEEN 0.5 AND 2.4 THEN 0.5 ELSE 0 END)), 6) AS phi
FROM c a JOIN c b ON a.path_id = b.path_id AND b.t < a.t AND a.t - b.t <= 2.5 GROUP BY a.path_id, a.dim, b.dim""")
def banded_pairs_long(spark, d):
    """Pairs of two long paths within 2.5 days, the reach of a uniform kernel of width 2 after half a day."""
    k = kernels.Uniform(1.0, 2.0, 0.5)
    p = banded.banded_counts(long_paths(spark, d), k.reach())
    return p.groupBy("path_id", "k", "j").agg(F.sum("n").alias("n"), r(F.sum(col("n") * k.phi(col("dt"))), 6).alias("phi"))


# --- power laws by the scan

POWER_PHI, POWER_PSI, U_POWER = "1.5 * 0.7 * pow(1 + 0.7 * dt, -2.5)", "(1 - pow(1 + 0.7 * dt, -1.5))", "(1 + 0.001 * mark)"


@query(f"""WITH {EV}, {PAIR} SELECT e.path_id, e.dim AS k, e.event_id AS m, round(0.01 * (e.dim + 1) + 0.05 * (e.dim + 1) * coalesce(s, 0), 6) AS intensity FROM ev e
LEFT JOIN (SELECT m, sum({POWER_PHI} * {U_POWER}) AS s FROM pr GROUP BY m) p ON p.m = e.event_id""")
def intensity_power_law_scan(spark, d):
    """Power-law excitation by marks, through sums of exponentials within 1e-12."""
    gain = [0.05 * (k + 1) for k in range(DIMS)]
    out = powerscan.power_law_intensity(events_of(spark, d), [0.01 * (k + 1) for k in range(DIMS)], gain, 1.5, 0.7, 1 + 0.001 * col("mark"), tolerance=1e-12)
    return out.select("path_id", "k", "m", r("intensity", 6).alias("intensity"))


@query(f"""WITH {EV}, {PAIR}, c AS (SELECT e.path_id, e.dim AS k, e.event_id AS m, e.t, 0.01 * (e.dim + 1) * e.t + 0.05 * (e.dim + 1) * coalesce(s, 0) AS comp FROM ev e
  LEFT JOIN (SELECT m, sum({POWER_PSI} * {U_POWER}) AS s FROM pr GROUP BY m) p ON p.m = e.event_id)
SELECT k, count(*) AS n, round(sum(residual), 3) AS total, round(sum(residual * residual), 3) AS squares FROM (SELECT k, comp - lag(comp) OVER (PARTITION BY path_id, k ORDER BY t, m) AS residual FROM c) WHERE residual IS NOT NULL GROUP BY k""")
def residuals_power_law_scan(spark, d):
    """Residuals of the same model, from counts and decayed sums of one scan: their number, sum and sum of squares by dimension."""
    gain = [0.05 * (k + 1) for k in range(DIMS)]
    c = powerscan.power_law_compensators(events_of(spark, d), [0.01 * (k + 1) for k in range(DIMS)], gain, 1.5, 0.7, 1 + 0.001 * col("mark"), tolerance=1e-12)
    x = col("residual")
    return sums.residuals(c).groupBy("k").agg(F.count(F.lit(1)).alias("n"), r(F.sum(x), 3).alias("total"), r(F.sum(x * x), 3).alias("squares"))


# --- Poisson models

BREAKS = [0.0, 100.0, 250.0, 500.0, 720.0]
PIECES = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(BREAKS, BREAKS[1:], strict=False)))
PATHS = "(SELECT CAST(count(DISTINCT path_id) AS DOUBLE) FROM ev)"


@query(f"""WITH {EV}, p(piece, a, b) AS (VALUES {PIECES}), n AS (SELECT CAST(g.dim AS INT) AS dim, piece, a, b, count(t) AS n FROM range(5) AS g(dim) CROSS JOIN p LEFT JOIN ev ON ev.dim = g.dim AND t >= a AND t < b GROUP BY ALL)
SELECT dim, piece, n / ((b - a) * {PATHS}) AS level, round(-pow(n / ((b - a) * {PATHS}), 2) * (b - a) / 720.0, 12) AS lse, round(CASE WHEN n > 0 THEN n * ln(n / ((b - a) * {PATHS})) - n ELSE 0 END, 6) AS loglik FROM n""")
def poisson_fit_pieces(spark, d):
    e = events_of(spark, d)
    out = poisson.fit_pieces(e, BREAKS, DIMS, e.select("path_id").distinct().count())
    return out.select("dim", "piece", "level", r("lse", 12).alias("lse"), r("loglik", 6).alias("loglik"))


@query(f"""WITH {EV}, z AS (SELECT dim, CAST(i AS INT) AS i, count(*) / ({TOTAL}) AS level, 2 * sum(cos(2 * pi() * i / 720.0 * t)) / ({TOTAL}) AS a, 2 * sum(sin(2 * pi() * i / 720.0 * t)) / ({TOTAL}) AS b FROM ev, range(1, 41) AS g(i) GROUP BY dim, i)
SELECT dim, i, round(level, 8) AS level, round(a, 8) AS cosine, round(b, 8) AS sine, round(-level * level - (a * a + b * b) / 2, 10) AS lse FROM z QUALIFY row_number() OVER (PARTITION BY dim ORDER BY -(a * a + b * b), i) = 1""")
def poisson_fit_cosine(spark, d):
    """The harmonic of the horizon, of the first forty, that fits each dimension's rate best."""
    e, f = events_of(spark, d), [2 * np.pi * i / HORIZON for i in range(1, 41)]
    got = poisson.fit_cosine(e, f, HORIZON, e.select("path_id").distinct().count())
    rows = [(x.dim, 1 + f.index(x.frequency), x.level, x.cosine, x.sine, x.lse) for x in got]
    out = spark.createDataFrame(rows, "dim int, i int, level double, cosine double, sine double, lse double")
    return out.select("dim", "i", *[r(c).alias(c) for c in ("level", "cosine", "sine")], r("lse", 10).alias("lse"))


@query(f"""WITH {EV}, s AS (SELECT dim AS k, sum(t) AS st, count(*) AS n, sum(t / (0.0001 * t + 0.01 * (dim + 1))) AS lt, sum(1 / (0.0001 * t + 0.01 * (dim + 1))) AS l1 FROM ev GROUP BY dim)
SELECT k, 0 AS i, round(2 * 0.0001 * 720.0 * 720.0 / 3 + 0.01 * (k + 1) * 720.0 - 2 * st / ({TOTAL}), 5) AS by_lse, round(lt - {PATHS} * 720.0 * 720.0 / 2, 1) AS by_loglik FROM s
UNION ALL SELECT k, 1, round(0.0001 * 720.0 + 2 * 0.01 * (k + 1) - 2 * n / ({TOTAL}), 5), round(l1 - {PATHS} * 720.0, 1) FROM s""")
def poisson_gradients(spark, d):
    """Derivatives of both losses by slope and level of a linear rate."""
    e = events_of(spark, d)
    out = poisson.poisson_gradients(e, baselines.Linear, [(0.0001, 0.01 * (k + 1)) for k in range(DIMS)], HORIZON, e.select("path_id").distinct().count())
    return out.select("k", "i", r("by_lse", 5).alias("by_lse"), r("by_loglik", 1).alias("by_loglik"))


# --- sampled sums and gradients beside the exact ones: within five deviations of what a linear pass gives


def beside_exact(spark, got, exact: dict[str, float], digits: int = 6):
    """(name, size, exact, near) of estimates (name, total, variance, size)."""
    rows = spark.createDataFrame([(n, float(x)) for n, x in exact.items()], "name string, exact double")
    near = F.abs(col("total") - col("exact")) <= 5 * F.sqrt("variance") + 1e-9 * F.abs("exact")
    return got.join(F.broadcast(rows), "name").select("name", "size", r("exact", digits).alias("exact"), near.alias("near"))


@query(f"""WITH {EV}, {PAIR} SELECT 'decay' AS name, count(*) AS size, round(sum(exp(-0.7 * dt)), 6) AS exact, TRUE AS near FROM pr
UNION ALL SELECT 'weighted', count(*), round(sum(exp(-0.7 * dt) * (1 + 0.001 * mark)), 6), TRUE FROM pr""")
def stratified_estimate(spark, d):
    """Sampled sums over all pairs with the exact ones, which the linear scan gives."""
    e = events_of(spark, d)
    values = {"decay": F.exp(-0.7 * col("dt")), "weighted": F.exp(-0.7 * col("dt")) * (1 + 0.001 * col("mark"))}
    got = sampling.adaptive_pair_sum(e, DIMS, strata.lag_strata(1 << 20, 5, 6), values, 2000)
    exact = expscan.exp_sums(e, [(0.7, F.lit(1.0)), (0.7, 1 + 0.001 * col("mark"))], list(values)).agg(*[F.sum(c).alias(c) for c in values]).first()
    return beside_exact(spark, got, exact.asDict())


@query(f"""WITH {EV} SELECT 'psi' AS name, count(*) AS size, round(sum(1 - exp(-0.7 * (720.0 - t))), 6) AS exact, TRUE AS near FROM ev
UNION ALL SELECT 'psi_marked', count(*), round(sum((1 - exp(-0.7 * (720.0 - t))) * (1 + 0.001 * mark)), 6), TRUE FROM ev""")
def psi_estimate(spark, d):
    """Single sums from three domains: the last events of each path and type whole, those before by their deviations, the far ones by their number."""
    e = events_of(spark, d)
    psi = 1 - F.exp(-0.7 * (HORIZON - col("t")))
    values = {"psi": psi, "psi_marked": psi * (1 + 0.001 * col("mark"))}
    places = sampling.place_singles(e, strata.lag_strata(1 << 20, 4, 8))
    got = sampling.estimated_sums(places, values, sampling.Domains(2, 4, 500, 500), single=True)
    exact = e.agg(*[F.sum(v).alias(n) for n, v in values.items()]).first()
    return beside_exact(spark, got, exact.asDict())


@query(f"""WITH {EV}, {PAIR} SELECT 'upsilon' AS name, count(*) AS size, round(sum(0.35 * exp(-0.7 * dt) * (1 - exp(-1.4 * (720.0 - t)))), 6) AS exact, TRUE AS near FROM pr""")
def upsilon_estimate(spark, d):
    """A double sum from three domains: the nearest lags whole, the next by their deviations, the far ones by their number."""
    e = events_of(spark, d)
    value = lambda s: 0.35 * s * (1 - F.exp(-1.4 * (HORIZON - col("t"))))
    places = sampling.place_pairs(e, DIMS, strata.lag_strata(1 << 20, 4, 6))
    got = sampling.estimated_sums(places, {"upsilon": value(F.exp(-0.7 * col("dt")))}, sampling.Domains(1, 5, 1500, 500))
    exact = expscan.exp_sums(e, [(0.7, F.lit(1.0))], ["s"]).agg(F.sum(value(col("s"))).alias("upsilon")).first()
    return beside_exact(spark, got, exact.asDict())


@query(ORACLES["lse_gradient"].replace("SELECT name, k, CAST(j AS INT) AS j, round(sum(x)", "SELECT name, k, CAST(j AS INT) AS j, TRUE AS near, round(sum(x)"))
def lse_gradient_sampled(spark, d):
    """The loss's gradient with whether the one from 8,000 sampled pairs is within five deviations of it."""
    e = events_of(spark, d)
    n, b, w, level = e.select("path_id").distinct().count(), np.array(BETA_M), np.array(OMEGA_M), np.array(MU_V)
    _, exact = marked.scan_sums(e, b, HORIZON, n).loss_and_gradient(level, np.zeros(DIMS), w)
    places = sampling.place_pairs(e, DIMS, strata.lag_strata(1 << 20, 5, 6))
    pilot = sampling.sampled_gradient(places, strata.neyman_allocation(places.sizes, {}, 4000), 5, level, w, b, HORIZON, n)
    got = sampling.sampled_gradient(places, strata.neyman_allocation(places.sizes, pilot.spread, 8000), 6, level, w, b, HORIZON, n)
    near = lambda c, *at: bool(abs(got.value[c][at] - exact[c][at]) <= 5 * np.sqrt(got.variance[c][at]) + 1e-12)
    rows = [("mu", k, -1, near("level", k), float(exact["level"][k])) for k in range(DIMS)]
    rows += [(c, k, j, near(c, k, j), float(exact[c][k, j])) for c in ("omega", "beta") for k in range(DIMS) for j in range(DIMS)]
    return spark.createDataFrame(rows, "name string, k int, j int, near boolean, value double").withColumn("value", r("value"))


@query(f"""WITH {EV}, c AS (SELECT CAST(k AS INT) AS dim, sum({OMEGA} * (exp(-{BETA} * (360.0 - t)) - exp(-{BETA} * (720.0 - t)))) AS e FROM (SELECT dim AS j, t FROM ev WHERE t < 360.0), range(5) AS g(k) GROUP BY k)
SELECT 'children' AS name, dim, round(e, 6) AS expected, TRUE AS near FROM c
UNION ALL SELECT 'immigrants', CAST(k AS INT), round(0.01 * (k + 1) * 360.0 * (SELECT max(path_id) + 1 FROM ev), 6), TRUE FROM range(5) AS g(k)""")
def hawkes_simulation(spark, d):
    """Every path goes on from its first half: the expected numbers of children of its events and of immigrants in the second half, and whether the simulated ones are within five deviations."""
    e = events_of(spark, d)
    past = e.where(col("t") < 360.0)
    paths = e.agg(F.max("path_id")).first()[0] + 1
    model = dict(mu=np.array(MU_V), kernel=lambda k, j: kernels.Exponential(OMEGA_M[k][j], BETA_M[k][j]), mean=np.array(OMEGA_M), horizon=HORIZON, seed=7)
    out = simulate.simulate_hawkes(spark, paths=paths, history=past, since=360.0, **model)
    own = past.select(F.xxhash64("event_id", F.lit(7)).alias("root_id"))
    kinds = [("immigrants", out.where("generation = 0")), ("children", out.where("generation = 1").join(own, "root_id", "left_semi"))]
    counts = kinds[0][1].select("dim", F.lit("immigrants").alias("name")).unionByName(kinds[1][1].select("dim", F.lit("children").alias("name"))).groupBy("name", "dim").agg(F.count(F.lit(1)).alias("n"))
    psi = sums.psi_sums(past, lambda k, j: kernels.Exponential(_at(OMEGA_M, k, j), _at(BETA_M, k, j)), DIMS, HORIZON).groupBy("k").agg(F.sum("psi").alias("to_end"))
    half = sums.psi_sums(past, lambda k, j: kernels.Exponential(_at(OMEGA_M, k, j), _at(BETA_M, k, j)), DIMS, 360.0).groupBy("k").agg(F.sum("psi").alias("to_half"))
    children = psi.join(half, "k").select(F.lit("children").alias("name"), col("k").alias("dim"), (col("to_end") - col("to_half")).alias("expected"))
    rows = spark.createDataFrame([("immigrants", k, MU_V[k] * 360.0 * paths) for k in range(DIMS)], "name string, dim int, expected double").unionByName(children)
    near = F.abs(F.coalesce("n", F.lit(0)) - col("expected")) <= 5 * F.sqrt("expected")
    return rows.join(counts, ["name", "dim"], "left").select("name", "dim", r("expected", 6).alias("expected"), near.alias("near"))


def _at(m, k, j):
    return F.get(F.get(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m]), k), j)


# --- sums of baselines, Kepler's series, mark laws


@query(f"""{AT} SELECT event_id, round(0.3 + 0.02 * x + 0.2 + 0.4 * (1 + cos(1.5 * x + 0.3)) + CASE WHEN x >= 3 THEN 0.5 ELSE 0.1 END, 8) AS mu,
  round(0.3 * x + 0.01 * x * x + 0.2 * x + 0.4 * x + 0.4 * (sin(1.5 * x + 0.3) - sin(0.3)) / 1.5 + 0.1 * least(x, 3.0) + 0.5 * greatest(x - 3.0, 0), 8) AS integral, round(x, 7) AS back FROM p""")
def baseline_sum(spark, d):
    """A sum of a line, a cosine and pieces: rate, integral, and the inverse of the integral."""
    x = col("x")
    b = baselines.Sum((baselines.Linear(0.02, 0.3), baselines.Cosine(0.2, 0.4, 1.5, 0.3), baselines.PiecewiseConstant((0.0, 3.0), (0.1, 0.5))))
    return at_times(spark, d).select("event_id", r(b.mu(x)).alias("mu"), r(b.compensator(x)).alias("integral"), r(b.inverse(b.compensator(x), 20.0), 7).alias("back"))


@query(f"{AT} SELECT event_id, round(x, 8) AS back, round(x, 7) AS cosine_back FROM p")
def kepler_series(spark, d):
    """Kepler's equation undone by the Kapteyn series, and the integral of a cosine rate by its own inverse."""
    x, c = col("x"), baselines.Cosine(0.3, 0.5, 1.5, 0.3)
    return at_times(spark, d).select("event_id", r(scalars.inverse_kepler_series(scalars.kepler(x, 0.6), 0.6)).alias("back"), r(c.inverse(c.compensator(x)), 7).alias("cosine_back"))


@query(f"""WITH {EV}, {PAIR}, mm AS (SELECT dim AS j, 1 + 0.001 * avg(mark) AS h FROM ev GROUP BY dim),
c AS (SELECT e.path_id, e.dim AS k, e.event_id AS m, e.t, 0.01 * (e.dim + 1) * e.t + coalesce(s, 0) AS comp FROM ev e LEFT JOIN (SELECT m, sum(h * {OMEGA} * (1 - exp(-{BETA} * dt))) AS s FROM pr JOIN mm USING (j) GROUP BY m) p ON p.m = e.event_id)
SELECT k, count(*) AS n, round(sum(residual), 4) AS total, round(sum(residual * residual), 4) AS squares FROM (SELECT k, comp - lag(comp) OVER (PARTITION BY path_id, k ORDER BY t, m) AS residual FROM c) WHERE residual IS NOT NULL GROUP BY k""")
def residuals_expected(spark, d):
    """Residuals of a marked model with the expected impacts of its mark laws, which are exponential with each type's mean."""
    e = events_of(spark, d)
    mean = {x["dim"]: x["mean"] for x in e.groupBy("dim").agg(F.avg("mark").alias("mean")).collect()}  # a row for each dimension
    h = [marks.expected_impact(marks.Exponential(1 / mean[j]), impacts.LINEAR, 0.001) if j in mean else 1.0 for j in range(DIMS)]
    c = expscan.exp_compensators(e, MU_V, [[OMEGA_M[k][j] * h[j] for j in range(DIMS)] for k in range(DIMS)], BETA_M)
    x = col("residual")
    return sums.residuals(c).groupBy("k").agg(F.count(F.lit(1)).alias("n"), r(F.sum(x), 4).alias("total"), r(F.sum(x * x), 4).alias("squares"))


@query(f"{AT} SELECT event_id, round(0.8 * (1 - exp(-x * x / (2 * 1.7 * 1.7))), 6) AS rayleigh, round(0.8 * (1 - pow(1 + 0.7 * x, -1.5)), 6) AS power_law, round(0.8 * (1 - exp(-1.3 * x)), 6) AS exponential FROM p")
def kernel_tabulated(spark, d):
    """Integrals of kernels known by their densities alone, from tables within 1e-10."""
    x = col("x")
    laws = {
        "rayleigh": (lambda t: t / 2.89 * np.exp(-t * t / 5.78), lambda t: t / 2.89 * F.exp(-t * t / 5.78)),
        "power_law": (lambda t: 1.05 * (1 + 0.7 * t) ** -2.5, lambda t: 1.05 * F.pow(1 + 0.7 * t, -2.5)),
        "exponential": (lambda t: 1.3 * np.exp(-1.3 * t), lambda t: 1.3 * F.exp(-1.3 * t)),
    }
    kernel = {n: tabulated.Tabulated(0.8, c, tabulated.integral_table(f, 20.0, 1e-10)) for n, (f, c) in laws.items()}
    return at_times(spark, d).select("event_id", *[r(k.psi(x), 6).alias(n) for n, k in kernel.items()])


def _cross_sql() -> str:
    """Upsilon of the pairs of ``upsilon_cross`` at lag 0.4, in closed form."""
    v1, v2, m1, m2 = 1.44, 0.81, 2.0, 2.6
    mean, std, wide = (m1 * v2 + m2 * v1) / (v1 + v2), np.sqrt(v1 * v2 / (v1 + v2)), np.sqrt(v1 + v2)
    peak = 0.4 * np.exp(-((m1 - m2) ** 2) / (2 * wide**2)) / (wide * np.sqrt(2 * np.pi))
    eg, ge = 2.6 - 1.3 * 0.81, 2.0 - 0.6 * 1.44
    c_eg, c_ge = 0.4 * 1.3 * np.exp(-1.3 * 2.6 + 0.5 * 1.3**2 * 0.81), 0.4 * 0.6 * np.exp(-0.6 * 0.4 - 0.6 * 2.0 + 0.5 * 0.6**2 * 1.44)
    n = {c: (f"({v!r} + 0 * x)" if isinstance(v, float) else v) for c, v in {"a1": f"((x - {mean!r}) / {float(std)!r})", "a0": float(-mean / std), "b1": f"((x - {eg!r}) / 0.9)", "b0": float(-eg / 0.9), "c1": f"((x - {ge!r}) / 1.2)", "c0": float(-ge / 1.2)}.items()}
    z = ", ".join(f"{v} AS {c}" for c, v in n.items())
    mass = lambda c: f"({normal_sql(c + '1')} - {normal_sql(c + '0')})"
    g = 1.3 * 0.6 / 1.9
    late = "exp(-1.3 * ({0} - 1.0) - 0.6 * ({0} + 0.4 - 2.0))"
    return f"""{AT}, z AS (SELECT event_id, x, {z} FROM p) SELECT event_id, round({float(peak)!r} * {mass("a")}, 8) AS gauss_gauss, round({float(c_eg)!r} * {mass("b")}, 8) AS exp_gauss, round({float(c_ge)!r} * {mass("c")}, 8) AS gauss_exp,
  round(CASE WHEN x <= 1.6 THEN 0 ELSE 0.4 * {g!r} * ({late.format("1.6")} - {late.format("x")}) END, 8) AS delayed, round(0.4 * greatest(least(2.5, 3.6, x) - 0.6, 0) / 6.0, 8) AS uniform FROM z"""


@query(_cross_sql())
def upsilon_cross(spark, d):
    """Upsilon of kernels of other kinds than two exponentials."""
    x, k = col("x"), kernels
    pairs = {
        "gauss_gauss": (k.Gaussian(0.8, 1.2, 2.0), k.Gaussian(0.5, 0.9, 3.0)), "exp_gauss": (k.Exponential(0.8, 1.3), k.Gaussian(0.5, 0.9, 3.0)), "gauss_exp": (k.Gaussian(0.8, 1.2, 2.0), k.Exponential(0.5, 0.6)),
        "delayed": (k.DelayedExponential(0.8, 1.3, 1.0), k.DelayedExponential(0.5, 0.6, 2.0)), "uniform": (k.Uniform(0.8, 2.0, 0.5), k.Uniform(0.5, 3.0, 1.0)),
    }
    return at_times(spark, d).select("event_id", *[r(a.upsilon(b, x, 0.4)).alias(n) for n, (a, b) in pairs.items()])


@query(f"""{AT} SELECT event_id, round(CASE WHEN x < 1 OR x > 6 THEN 0 WHEN x <= 3 THEN (x - 1) / 2 ELSE (6 - x) / 3 END, 8) AS tri, round(exp(-x) / pow(1 + exp(-x), 2), 8) AS logistic_pdf,
  CAST((x >= 0.5)::INT + (x >= 2)::INT + (x >= 2.5)::INT + (x >= 7)::INT - 1 AS INT) AS bucket, round(mark * exp(-0.7 * x) + 1, 8) AS updated,
  round(1 - 0.6 * cos(x), 4) AS kepler_slope FROM p""")
def scalar_steps(spark, d):
    """The triangle, the logistic's density, places on a grid, an updated decayed sum, and a derivative by differences."""
    x = col("x")
    slope = scalars.difference_columns(lambda y: scalars.kepler(x + y, 0.6), [0.0])[0]
    return at_times(spark, d).select(
        "event_id", r(scalars.tri(x, 1.0, 2.0, 3.0)).alias("tri"), r(scalars.logistic_pdf(x)).alias("logistic_pdf"), scalars.bucket_of(x, [0.5, 2.0, 2.5, 7.0]).alias("bucket"),
        r(expscan.updated_exp_sum(col("mark"), x, 0.7)).alias("updated"), r(slope, 4).alias("kepler_slope"),
    )
