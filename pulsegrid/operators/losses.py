"""Losses of marked models with time-dependent baselines and of Poisson models, and the gradient of exponential models.

All are sums over events or pairs by dimension; what comes to the driver is a few numbers for each pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import sums
from pulsegrid.operators.expscan import exp_sums
from pulsegrid.operators.sums import KernelOf

col = F.col


def baseline_sums(events: DataFrame, mu: Callable[[Column, Column], Column]) -> DataFrame:
    """(k, mu): the sum of mu_k over the type-k events."""
    return events.groupBy(col("dim").alias("k")).agg(F.sum(mu(col("dim"), col("t"))).alias("mu"))


def k_sums(events: DataFrame, k_of: Callable[[Column, Column, Column, Column], Column], dims: int, horizon: float, impact=None) -> DataFrame:
    """(k, j, total): sum over type-j events of K_kj(T - t, t), the integral of the kernel times mu_k after the event, times the impact.

    ``k_of(k, j, left, t)`` is that integral, as ``Exponential.linear_k`` gives it.
    """
    rows = events.select("dim", "t", "mark", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("k"))
    value = k_of(col("k"), col("dim"), F.lit(horizon) - col("t"), col("t"))
    if impact:
        value = value * impact(col("k"), col("dim"), col("mark"))
    return rows.groupBy("k", col("dim").alias("j")).agg(F.sum(value).alias("total"))


def marked_least_squares(
    events: DataFrame, kernel: KernelOf, mu: Callable[[Column, Column], Column], mean_square: Callable[[Column], Column], k_of: Callable[[Column, Column, Column, Column], Column], impact, dims: int, horizon: float, paths: int = 1
) -> DataFrame:
    """(k, lse): the mean of mu^2 + (2 sum K + sum upsilon0 + 2 sum upsilon - 2 sum phi - 2 sum mu) / T, each term with its impacts."""
    pair = sums.pairs(events)
    total = F.lit(float(horizon * paths))
    parts = [
        events.sparkSession.range(dims).select(col("id").cast("int").alias("k"), mean_square(col("id").cast("int")).alias("x")),
        baseline_sums(events, mu).select("k", (-2 * col("mu") / total).alias("x")),
        k_sums(events, k_of, dims, horizon, impact).select("k", (2 * col("total") / total).alias("x")),
        sums.upsilon_zero_sums(events, kernel, dims, horizon, impact).select("k", (col("upsilon") / total).alias("x")),
        sums.upsilon_sums(pair, kernel, dims, horizon, impact).select("k", (2 * col("upsilon") / total).alias("x")),
        sums.phi_sums(pair, kernel, impact).select("k", (-2 * col("phi") / total).alias("x")),
    ]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy("k").agg(F.sum("x").alias("lse"))


def poisson_losses(events: DataFrame, mu: Callable[[Column, Column], Column], mean_square: Callable[[Column], Column], compensator: Callable[[Column], Column], dims: int, horizon: float, paths: int = 1) -> DataFrame:
    """(k, lse, loglik) of Poisson models: mean of mu^2 less 2 / T times the sum of mu, and the sum of log mu less the compensators."""
    rows = events.sparkSession.range(dims).select(col("id").cast("int").alias("k"))
    seen = events.groupBy(col("dim").alias("k")).agg(F.sum(mu(col("dim"), col("t"))).alias("mu"), F.sum(F.log(mu(col("dim"), col("t")))).alias("log"))
    out = rows.join(seen, "k", "left")
    lse = mean_square(col("k")) - 2 * F.coalesce("mu", F.lit(0.0)) / float(horizon * paths)
    return out.select("k", lse.alias("lse"), (F.coalesce("log", F.lit(0.0)) - paths * compensator(col("k"))).alias("loglik"))


def fit_linear_poisson(events: DataFrame, horizon: float, paths: int = 1) -> DataFrame:
    """(dim, slope, level): the least-squares line of the rate, which the number of events and the sum of their times tell."""
    t = float(horizon)
    per = events.groupBy("dim").agg((F.count(F.lit(1)) / F.lit(t * paths)).alias("eta"), (F.sum("t") / F.lit(t * paths)).alias("first"))
    slope = (col("first") - col("eta") * (t / 2)) * (12 / t**2)
    return per.select("dim", slope.alias("slope"), (col("eta") - slope * (t / 2)).alias("level"))


def exponential_gradient(events: DataFrame, mu: np.ndarray, omega: np.ndarray, beta: np.ndarray, horizon: float, paths: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of the least-squares loss by (mu_k, omega_kj, beta_kj): one aggregate by (k, dimension), without pairs.

    With the decayed sum S comes R, the same of dt exp(-beta dt), as the decays' derivative needs it.
    """
    d = len(mu)
    is_dim = [(col("dim") == j).cast("double") for j in range(d)]
    terms, names = [], []
    for k in range(d):
        for j in range(d):
            terms += [(float(beta[k, j]), is_dim[j]), (float(beta[k, j]), is_dim[j] * col("t"))]
            names += [f"s{k}_{j}", f"u{k}_{j}"]
    rows = exp_sums(events, terms, names)
    left = F.lit(float(horizon)) - col("t")
    each = []
    for k in range(d):
        of_dim = F.get(F.array(*[F.lit(float(b)) for b in beta[k]]), col("dim"))
        part = [F.struct(col(f"s{k}_{j}").alias("s"), (col("t") * col(f"s{k}_{j}") - col(f"u{k}_{j}")).alias("r"), F.lit(float(beta[k, j])).alias("b")) for j in range(d)]
        each.append(F.struct(F.lit(k).alias("k"), of_dim.alias("own"), F.array(*part).alias("by")))
    flat = rows.select("dim", left.alias("left"), F.explode(F.array(*each)).alias("x"))
    flat = flat.select("dim", "left", "x.k", "x.own", *[col("x.by")[j].alias(f"y{j}") for j in range(d)])
    aggregates = [F.count(F.lit(1)).alias("n")]
    b = col("own")
    aggregates += [F.sum(1 - F.exp(-b * col("left"))).alias("psi"), F.sum(col("left") * F.exp(-b * col("left"))).alias("dpsi")]
    aggregates += [F.sum(1 - F.exp(-2 * b * col("left"))).alias("own"), F.sum(col("left") * F.exp(-2 * b * col("left"))).alias("down")]
    for j in range(d):
        y = col(f"y{j}")
        e = F.exp(-(b + y["b"]) * col("left"))
        aggregates += [F.sum(y["s"]).alias(f"s{j}"), F.sum(y["r"]).alias(f"r{j}"), F.sum((1 - e) * y["s"]).alias(f"as{j}"), F.sum((1 - e) * y["r"]).alias(f"ar{j}"), F.sum(col("left") * e * y["s"]).alias(f"es{j}")]
    got = {(r["k"], r["dim"]): r for r in flat.groupBy("k", "dim").agg(*aggregates).collect()}  # a row for each pair of dimensions
    total = float(horizon * paths)
    g_mu, g_omega, g_beta = np.zeros(d), np.zeros((d, d)), np.zeros((d, d))
    for k in range(d):
        n = got[k, k]["n"] if (k, k) in got else 0
        g_mu[k] = 2 * mu[k] - 2 * n / total + 2 * sum(omega[k, j] * got[k, j]["psi"] for j in range(d) if (k, j) in got) / total
        for j in range(d):
            w, bj = omega[k, j], beta[k, j]
            if (k, j) in got:
                r = got[k, j]
                g_omega[k, j] += 2 * mu[k] * r["psi"] + w * bj * r["own"]
                g_beta[k, j] += 2 * mu[k] * w * r["dpsi"] + w * w / 2 * r["own"] + w * w * bj * r["down"]
            if (k, k) in got:
                r = got[k, k]
                g_omega[k, j] -= 2 * bj * r[f"s{j}"]
                g_beta[k, j] -= 2 * w * (r[f"s{j}"] - bj * r[f"r{j}"])
            for i in range(d):
                # a later event of type i after one of type j
                if (k, i) not in got:
                    continue
                r, wi, bi = got[k, i], omega[k, i], beta[k, i]
                g = bi * bj / (bi + bj)
                g_omega[k, j] += 2 * wi * g * r[f"as{j}"]
                g_omega[k, i] += 2 * w * g * r[f"as{j}"]
                g_beta[k, i] += 2 * wi * w * ((bj / (bi + bj)) ** 2 * r[f"as{j}"] + g * r[f"es{j}"])
                g_beta[k, j] += 2 * wi * w * ((bi / (bi + bj)) ** 2 * r[f"as{j}"] + g * r[f"es{j}"] - g * r[f"ar{j}"])
    return g_mu, g_omega / total, g_beta / total


def basis_terms(events: DataFrame, bases: Callable[[int], KernelOf], n_bases: int, dims: int, horizon: float, paths: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each k the (Q, c) of LSE_k = x'Qx - 2c'x over x = (mu_k, weights of the bases of every source), for fixed bases of any kind.

    Where only weights are free, as with sums of basis functions, a fit is this one pass over the pairs and ``fit.bounded_quadratic``.
    """
    pair = sums.pairs(events)
    total = horizon * paths
    n = dims * n_bases
    out = [(np.zeros((n + 1, n + 1)), np.zeros(n + 1)) for _ in range(dims)]
    for r in events.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["dim"]][1][0] = r["n"] / total
    psi, phi, own, ups = [], [], {}, {}
    rows = events.select("dim", "t", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("k"))
    later = pair.select(col("k").alias("i"), "j", "t", "dt", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("k"))
    left = F.lit(float(horizon)) - col("t")
    for p in range(n_bases):
        psi.append(F.sum(bases(p)(col("k"), col("dim")).psi(left)).alias(f"psi{p}"))
        phi.append(F.sum(bases(p)(col("k"), col("j")).phi(col("dt"))).alias(f"phi{p}"))
        for q in range(n_bases):
            own[p, q] = F.sum(bases(p)(col("k"), col("dim")).upsilon(bases(q)(col("k"), col("dim")), left, F.lit(0.0))).alias(f"own{p}_{q}")
            ups[p, q] = F.sum(bases(p)(col("k"), col("i")).upsilon(bases(q)(col("k"), col("j")), left, col("dt"))).alias(f"ups{p}_{q}")
    for r in rows.groupBy("k", col("dim").alias("j")).agg(*psi, *own.values()).collect():
        q, _ = out[r["k"]]
        for a in range(n_bases):
            at = 1 + r["j"] * n_bases + a
            q[0, at] = q[at, 0] = r[f"psi{a}"] / total
            for b in range(n_bases):
                q[at, 1 + r["j"] * n_bases + b] += r[f"own{a}_{b}"] / total
    for r in pair.groupBy("k", "j").agg(*phi).collect():
        for a in range(n_bases):
            out[r["k"]][1][1 + r["j"] * n_bases + a] = r[f"phi{a}"] / total
    for r in later.groupBy("k", "i", "j").agg(*ups.values()).collect():
        q, _ = out[r["k"]]
        for a in range(n_bases):
            for b in range(n_bases):
                x, y = 1 + r["i"] * n_bases + a, 1 + r["j"] * n_bases + b
                q[x, y] += r[f"ups{a}_{b}"] / total
                q[y, x] += r[f"ups{a}_{b}"] / total
    for q, _ in out:
        q[0, 0] = 1.0
    return out
