"""Least-squares losses, gradients and fits of exponential Hawkes models with marks, linear baselines and horizons of their own, by one scan.

The intensity of a dimension k is c_k + a_k t plus, over all earlier events of type j with mark x, omega_kj beta_kj exp(-beta_kj dt) h(theta_kj, x).
With decays beta and impact parameters theta given, its loss is a quadratic in (c, a, omega).  All that this quadratic and its
derivatives by beta and theta need are sums over single events and, for pairs, sums over events of a product with decayed sums of their
predecessors: those of the impacts, of the impacts times dt, and of the impacts' derivatives.  So one linear
scan and one aggregate by (receiver, dimension) give loss and gradient at once; the driver gets a row for each pair of dimensions.

A fit alternates: the quadratic is solved exactly, with c and omega at least 0, and a gradient step moves decays and impact parameters;
at the best (c, a, omega) the loss changes with these alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.impacts import Family
from pulsegrid.operators.expscan import exp_sums
from pulsegrid.operators.fit import Adam, Schedule, bounded_quadratic, loss

col = F.col
#: For each receiver and dimension: over the events of the dimension, and for each source over their predecessors.
SINGLE = ("a", "b", "da", "db", "va", "vb", "own", "down", "vown")
PAIRED = ("phi", "dphi", "vphi", "ups", "ups_later", "ups_earlier", "vups_later", "vups_earlier")


@dataclass
class ScanSums:
    """The sums of a data set at given decays and impact parameters; ``moments`` are the integrals of 1, t and t^2 over all paths."""

    beta: np.ndarray
    moments: tuple[float, float, float]
    n: np.ndarray
    first: np.ndarray
    single: dict[str, np.ndarray]  # by (k, j)
    paired: dict[str, np.ndarray]  # by (k, i, j): later events of type i, earlier ones of type j

    def quadratic(self, k: int, slope: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(Q, c) of LSE_k = x'Qx - 2 c'x over x = (level, slope, omega_k0, omega_k1 ...), or without the slope."""
        d, (m1, m2, m3) = len(self.n), self.moments
        q, c = np.zeros((d + 2, d + 2)), np.zeros(d + 2)
        q[0, 0], q[0, 1], q[1, 0], q[1, 1] = m1, m2, m2, m3
        q[0, 2:] = q[2:, 0] = self.single["a"][k]
        q[1, 2:] = q[2:, 1] = self.single["b"][k]
        ups = self.paired["ups"][k]
        q[2:, 2:] = ups + ups.T + np.diag(self.single["own"][k])
        c[0], c[1], c[2:] = self.n[k], self.first[k], self.paired["phi"][k, k]
        keep = np.arange(d + 2) != (-1 if slope else 1)
        return q[np.ix_(keep, keep)] / m1, c[keep] / m1

    def loss_and_gradient(self, level: np.ndarray, slope: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """LSE_k, and its derivatives by level, slope (by k), omega, beta and theta (by k and j)."""
        d, m1 = len(self.n), self.moments[0]
        value = np.zeros(d)
        g = {"level": np.zeros(d), "slope": np.zeros(d), "omega": np.zeros((d, d)), "beta": np.zeros((d, d)), "theta": np.zeros((d, d))}
        s, p = self.single, self.paired
        for k in range(d):
            q, c = self.quadratic(k)
            x = np.r_[level[k], slope[k], omega[k]]
            value[k] = loss(q, c, x)
            by = 2 * (q @ x - c)
            g["level"][k], g["slope"][k], g["omega"][k] = by[0], by[1], by[2:]
            w = omega[k]
            for name, (one, line, own, phi, later, earlier) in {"beta": ("da", "db", "down", "dphi", "ups_later", "ups_earlier"), "theta": ("va", "vb", "vown", "vphi", "vups_later", "vups_earlier")}.items():
                crossed = w * (p[later][k] @ w) + w * (p[earlier][k].T @ w)
                g[name][k] = (2 * w * (level[k] * s[one][k] + slope[k] * s[line][k]) + w * w * s[own][k] + 2 * crossed - 2 * w * p[phi][k, k]) / m1
        return value, g


def with_ends(events: DataFrame, horizon: float | DataFrame, paths: int = 1) -> tuple[DataFrame, tuple[float, float, float]]:
    """``events`` with the time ``left`` to their path's end, and the integrals of 1, t, t^2 over all paths.

    ``horizon`` is one end for ``paths`` paths, or a table (path_id, horizon), in which paths without events count as well;
    events after their end, or of paths that it lacks, are left out.
    """
    if not isinstance(horizon, DataFrame):
        t = float(horizon)
        return events.withColumn("left", F.lit(t) - col("t")), (t * paths, t**2 / 2 * paths, t**3 / 3 * paths)
    h = col("horizon").cast("double")
    ends = horizon.select("path_id", h.alias("__end"))
    got = horizon.agg(F.sum(h), F.sum(h * h / 2), F.sum(h * h * h / 3)).first()
    rows = events.join(ends, "path_id").withColumn("left", col("__end") - col("t")).where("left >= 0").drop("__end")
    return rows, tuple(float(x or 0.0) for x in got)


def scan_sums(events: DataFrame, beta: np.ndarray, horizon: float | DataFrame, paths: int = 1, impact: Family | None = None, theta: np.ndarray | None = None, width: float | None = None) -> ScanSums:
    """One scan and one aggregate; ``impact`` with parameters ``theta`` (by receiver and source) scales each event by its mark."""
    d = len(beta)
    beta = np.asarray(beta, float)
    rows, moments = with_ends(events, horizon, paths)
    one, zero = F.lit(1.0), F.lit(0.0)
    value = lambda p: impact.value(p, col("mark")) if impact else one
    slope = lambda p: impact.slope(p, col("mark")) if impact else zero
    theta = np.zeros((d, d)) if theta is None else np.asarray(theta, float)
    terms: list[tuple[float, Column]] = []
    names: list[str] = []
    for k in range(d):
        for j in range(d):
            u, b = F.when(col("dim") == j, value(float(theta[k, j]))).otherwise(zero), float(beta[k, j])
            terms += [(b, u), (b, u * col("t"))]
            names += [f"s{k}_{j}", f"u{k}_{j}"]
            if impact:
                terms.append((b, F.when(col("dim") == j, slope(float(theta[k, j]))).otherwise(zero)))
                names.append(f"v{k}_{j}")
    rows = exp_sums(rows, terms, names, width)
    of_dim = lambda row: F.get(F.array(*[F.lit(float(x)) for x in row]), col("dim"))
    each = []
    for k in range(d):
        by = [
            F.struct(col(f"s{k}_{j}").alias("s"), (col("t") * col(f"s{k}_{j}") - col(f"u{k}_{j}")).alias("r"), (col(f"v{k}_{j}") if impact else zero).alias("v"), F.lit(float(beta[k, j])).alias("b")) for j in range(d)
        ]
        each.append(F.struct(F.lit(k).alias("k"), of_dim(beta[k]).alias("b"), of_dim(theta[k]).alias("p"), F.array(*by).alias("by")))
    flat = rows.select("dim", "t", "left", "mark", F.explode(F.array(*each)).alias("x")).select("dim", "t", "left", "x.k", "x.b", value(col("x.p")).alias("u"), slope(col("x.p")).alias("v"), "x.by")
    b, u, v, left = col("b"), col("u"), col("v"), col("left")
    out = _single_sums(b, u, v, left)
    for j in range(d):
        y = col("by")[j]
        c, s, rr, vv = y["b"], y["s"], y["r"], y["v"]
        both, end = b + c, F.exp(-(b + c) * left)
        g, m = b * c / both, 1 - end
        late, early = c / both * (c / both) * m + g * left * end, b / both * (b / both) * m + g * left * end
        pairs = {"phi": c * s, "dphi": s - c * rr, "vphi": c * vv, "ups": g * m * u * s, "ups_later": u * s * late, "ups_earlier": u * (s * early - g * m * rr), "vups_later": g * m * v * s, "vups_earlier": g * m * u * vv}
        out += [F.sum(x).alias(f"{name}{j}") for name, x in pairs.items()]
    found = _empty(beta, moments)
    for r in flat.groupBy("k", "dim").agg(*out).collect():  # a row for each pair of dimensions
        _take(found, r)
        for c in PAIRED:
            found.paired[c][r["k"], r["dim"]] = [r[f"{c}{j}"] for j in range(d)]
    return found


def _single_sums(b: Column, u: Column, v: Column, left: Column) -> list[Column]:
    t = col("t")
    e, e2 = F.exp(-b * left), F.exp(-2 * b * left)
    mass, tail = 1 - e, left * e
    line, d_line = t * mass + mass / b - tail, t * tail + tail / b - mass / (b * b) + left * tail
    sums = {
        "a": u * mass, "b": u * line, "da": u * tail, "db": u * d_line, "va": v * mass, "vb": v * line,
        "own": u * u * b / 2 * (1 - e2), "down": u * u * ((1 - e2) / 2 + b * left * e2), "vown": u * v * b * (1 - e2),
    }
    return [F.count(F.lit(1)).alias("n"), F.sum("t").alias("first"), *[F.sum(x).alias(c) for c, x in sums.items()]]


def _empty(beta: np.ndarray, moments: tuple[float, float, float]) -> ScanSums:
    d = len(beta)
    return ScanSums(np.asarray(beta, float), moments, np.zeros(d), np.zeros(d), {c: np.zeros((d, d)) for c in SINGLE}, {c: np.zeros((d, d, d)) for c in PAIRED})


def _take(found: ScanSums, r) -> None:
    k, i = r["k"], r["dim"]
    found.n[i], found.first[i] = r["n"], r["first"]
    for c in SINGLE:
        found.single[c][k, i] = r[c]


def single_sums(events: DataFrame, beta: np.ndarray, horizon: float | DataFrame, paths: int = 1, impact: Family | None = None, theta: np.ndarray | None = None) -> ScanSums:
    """``scan_sums`` without the sums over pairs, which stay 0: one aggregate, no scan."""
    d = len(beta)
    rows, moments = with_ends(events, horizon, paths)
    theta = np.zeros((d, d)) if theta is None else np.asarray(theta, float)
    cells = [F.struct(F.lit(k).alias("k"), *[F.get(F.array(*[F.lit(float(x)) for x in m[k]]), col("dim")).alias(n) for n, m in (("b", np.asarray(beta, float)), ("p", theta))]) for k in range(d)]
    rows = rows.select("dim", "t", "left", "mark", F.explode(F.array(*cells)).alias("x")).select("dim", "t", "left", "mark", "x.*")
    u = impact.value(col("p"), col("mark")) if impact else F.lit(1.0)
    v = impact.slope(col("p"), col("mark")) if impact else F.lit(0.0)
    found = _empty(beta, moments)
    for r in rows.groupBy("k", "dim").agg(*_single_sums(col("b"), u, v, col("left"))).collect():  # a row for each pair of dimensions
        _take(found, r)
    return found


@dataclass
class MarkedFit:
    level: np.ndarray
    slope: np.ndarray
    omega: np.ndarray
    beta: np.ndarray
    theta: np.ndarray
    lse: np.ndarray
    log: list[dict]


def best_linear(sums: ScanSums, slope: bool = False, min_level: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(level, slope, omega, lse) of least loss with level and omega at least 0; no further pass."""
    d = len(sums.n)
    level, line, omega, lse = np.zeros(d), np.zeros(d), np.zeros((d, d)), np.zeros(d)
    low = np.r_[min_level, [-np.inf] * slope, np.zeros(d)]
    for k in range(d):
        q, c = sums.quadratic(k, slope)
        x = bounded_quadratic(q, c, low)
        level[k], omega[k], lse[k] = x[0], x[1 + slope :], loss(q, c, x)
        line[k] = x[1] if slope else 0.0
    return level, line, omega, lse


def fit_marked(
    events: DataFrame, beta: np.ndarray, theta: np.ndarray | None = None, impact: Family | None = None, *, horizon: float | DataFrame, paths: int = 1, slope: bool = False, n_iter: int = 20, rate: float = 0.1, solver=None, shared: bool = False
) -> MarkedFit:
    """A fit from the start (beta, theta): ``n_iter`` steps on log beta and theta, each of one scan, and the exact (level, slope, omega) at each.

    With ``shared``, all receivers have one parameter theta for each source, and one decay.  ``n_iter`` = 0 fits (level, slope, omega) alone.  The log has a
    row for each step; a fit goes on where an earlier one ended if it starts from its parameters with its solver.
    """
    d = len(beta)
    theta = np.zeros((d, d)) if theta is None else np.array(theta, float)
    x, solver, log = np.r_[np.log(np.ravel(beta)), np.ravel(theta)], solver or Adam(Schedule(rate)), []
    low = np.r_[np.full(d * d, -np.inf), np.full(d * d, impact.low if impact else 0.0)]
    width = None
    for t in range(n_iter + 1):
        b, p = np.exp(x[: d * d]).reshape(d, d), x[d * d :].reshape(d, d)
        sums = scan_sums(events, b, horizon, paths, impact, p, width)
        level, line, omega, lse = best_linear(sums, slope)
        _, g = sums.loss_and_gradient(level, line, omega)
        step = np.r_[np.ravel(g["beta"] * b), np.ravel(g["theta"])]
        if shared:
            step = np.r_[_shared(step[: d * d], d), _shared(step[d * d :], d)]
        log.append({"step": t, "loss": float(lse.sum()), "gradient_norm": float(np.linalg.norm(step)), "level": level.tolist(), "slope": line.tolist(), "omega": omega.ravel().tolist(), "beta": b.ravel().tolist(), "theta": p.ravel().tolist()})
        if t < n_iter:
            x = np.maximum(solver.step(x, step, t), low)
    return MarkedFit(level, line, omega, b, p, lse, log)


def _shared(g: np.ndarray, d: int) -> np.ndarray:
    """Every receiver's derivative by a source's parameter, summed over the receivers."""
    return np.tile(g.reshape(d, d).sum(axis=0), d)


LOG_SCHEMA = "step int, loss double, gradient_norm double, level array<double>, slope array<double>, omega array<double>, beta array<double>, theta array<double>"


def log_frame(spark: SparkSession, log: Sequence[dict]) -> DataFrame:
    """A fit's log as a table, a row for each step; what ``sources.store`` writes and reads."""
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in LOG_SCHEMA.split(", ")) for r in log], LOG_SCHEMA)


def last_step(log: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(beta, theta) where a logged fit ended, from which another can go on."""
    r = log.orderBy(col("step").desc()).select("beta", "theta").first()
    return np.array(r["beta"]).reshape(dims, dims), np.array(r["theta"]).reshape(dims, dims)
