"""Fitting exponential Hawkes models by least squares: Spark aggregates, a driver of a few numbers steps.

With the decays fixed the loss of a dimension is a quadratic in (mu, omega): ``quadratic_terms`` computes its
matrix and vector in one pass over the linear-time sums, and a bounded solver ends the fit without further
passes.  With free decays ``fit_exponential`` makes one pass a step (see ``marked``).  Kernels that are sums of fixed bases of any kind are
a quadratic as well, whose terms are sums over pairs (``fit_bases``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.expscan import exp_sums
from pulsegrid.operators.losses import basis_terms

col = F.col


@dataclass
class Schedule:
    """Learning rates by step, and clipping of gradients.

    ``constant``: rate; ``exponential``: rate divided by ``divider`` once a ``period``, not under ``least``; ``linear``: rate / (offset + slope t); ``custom``: what
    ``custom(t)`` gives.  Without a rate each kind has its usual one.  With a ``window``, each component of a gradient is held within ``clip_offset`` plus ``clip_factor``
    times its largest size of the last ``window`` steps, once there have been as many.
    """

    rate: float | None = None
    kind: str = "constant"
    divider: float = 2.0
    period: int = 200
    least: float = 1e-3
    offset: float = 1.0
    slope: float = 0.1
    custom: Callable[[int], float] | None = None
    window: int | None = None
    clip_factor: float = 1.1
    clip_offset: float = 1.0

    def __post_init__(self):
        usual = {"constant": 0.01, "exponential": 0.1, "linear": 1.0, "custom": None}
        if self.kind not in usual or self.kind == "custom" and self.custom is None:
            raise ValueError("a schedule is constant, exponential, linear, or custom with a function of the step")
        self.rate = usual[self.kind] if self.rate is None else self.rate
        self.recent: deque[np.ndarray] = deque(maxlen=self.window or 1)

    def at(self, t: int) -> float:
        if self.kind == "custom":
            return self.custom(t)
        if self.kind == "exponential":
            return max(self.rate / self.divider ** (t // self.period), self.least)
        return self.rate / (self.offset + self.slope * t) if self.kind == "linear" else self.rate

    def clipped(self, g: np.ndarray) -> np.ndarray:
        if self.window is None:
            return g
        if len(self.recent) == self.window:
            most = self.clip_offset + self.clip_factor * np.max(self.recent, axis=0)
            g = np.clip(g, -most, most)
        self.recent.append(np.abs(g))
        return g


@dataclass
class Adam:
    schedule: Schedule = field(default_factory=Schedule)
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8

    def __post_init__(self):
        self.m = self.v = 0.0

    def step(self, x: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
        g = self.schedule.clipped(g)
        self.m, self.v = self.b1 * self.m + (1 - self.b1) * g, self.b2 * self.v + (1 - self.b2) * g * g
        return x - self.schedule.at(t) * (self.m / (1 - self.b1 ** (t + 1))) / (np.sqrt(self.v / (1 - self.b2 ** (t + 1))) + self.eps)


@dataclass
class Momentum:
    schedule: Schedule = field(default_factory=Schedule)
    keep: float = 0.9

    def __post_init__(self):
        self.v = 0.0

    def step(self, x: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
        self.v = self.keep * self.v - self.schedule.at(t) * self.schedule.clipped(g)
        return x + self.v


@dataclass
class RMSprop:
    schedule: Schedule = field(default_factory=Schedule)
    keep: float = 0.9
    eps: float = 1e-8

    def __post_init__(self):
        self.v = 0.0

    def step(self, x: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
        g = self.schedule.clipped(g)
        self.v = self.keep * self.v + (1 - self.keep) * g * g
        return x - self.schedule.at(t) * g / (np.sqrt(self.v) + self.eps)


def descend(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, low: np.ndarray, solver, n_iter: int = 1000, log: list | None = None) -> np.ndarray:
    """Projected gradient steps from ``x``; ``f`` gives the gradient."""
    for t in range(n_iter):
        g = f(x)
        if log is not None:
            log.append((t, x.copy(), g.copy()))
        x = np.maximum(solver.step(x, g, t), low)
    return x


def quadratic_terms(events: DataFrame, beta: np.ndarray, horizon: float, paths: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each k the (Q, c) of LSE_k = x'Qx - 2 c'x over x = (mu_k, omega_k0, omega_k1 ...).

    One aggregate over the exponential sums; its single row has d + d^2 (d + 2) numbers.
    """
    d = len(beta)
    total = horizon * paths
    is_dim = [(col("dim") == j).cast("double") for j in range(d)]
    # S_kj: the sum over type-j predecessors with decay beta_kj
    terms = [(float(beta[k, j]), is_dim[j]) for k in range(d) for j in range(d)]
    rows = exp_sums(events, terms, [f"s{k}_{j}" for k in range(d) for j in range(d)])
    left = horizon - col("t")
    out = [F.sum(is_dim[k]).alias(f"n{k}") for k in range(d)]
    for k in range(d):
        for j in range(d):
            b = float(beta[k, j])
            out.append(F.sum(is_dim[j] * (1 - F.exp(-b * left))).alias(f"psi{k}_{j}"))
            out.append(F.sum(is_dim[j] * (b / 2) * (1 - F.exp(-2 * b * left))).alias(f"own{k}_{j}"))
            out.append(F.sum(is_dim[k] * b * col(f"s{k}_{j}")).alias(f"phi{k}_{j}"))
            for i in range(d):
                # the later event is of type i, the earlier of type j
                bi = float(beta[k, i])
                out.append(F.sum(is_dim[i] * (bi * b / (bi + b)) * (1 - F.exp(-(bi + b) * left)) * col(f"s{k}_{j}")).alias(f"ups{k}_{i}_{j}"))
    got = rows.agg(*out).first().asDict()
    result = []
    for k in range(d):
        q, c = np.zeros((d + 1, d + 1)), np.zeros(d + 1)
        q[0, 0], c[0] = 1.0, got[f"n{k}"] / total
        for j in range(d):
            q[0, j + 1] = q[j + 1, 0] = got[f"psi{k}_{j}"] / total
            c[j + 1] = got[f"phi{k}_{j}"] / total
            q[j + 1, j + 1] += got[f"own{k}_{j}"] / total
            for i in range(d):
                q[i + 1, j + 1] += got[f"ups{k}_{i}_{j}"] / total
                q[j + 1, i + 1] += got[f"ups{k}_{i}_{j}"] / total
        result.append((q, c))
    return result


def loss(q: np.ndarray, c: np.ndarray, x: np.ndarray) -> float:
    return float(x @ q @ x - 2 * c @ x)


def bounded_quadratic(q: np.ndarray, c: np.ndarray, low: np.ndarray, n_iter: int = 10_000, tol: float = 1e-14) -> np.ndarray:
    """The minimum of x'Qx - 2c'x over x >= low by cyclic coordinate steps."""
    x = np.maximum(low, 0.0) + 0.0
    for _ in range(n_iter):
        before = x.copy()
        for i in range(len(x)):
            if q[i, i] > 0:
                x[i] = max(low[i], x[i] + (c[i] - q[i] @ x) / q[i, i])
        if np.max(np.abs(x - before)) <= tol * (1 + np.max(np.abs(x))):
            break
    return x


def fit_fixed_decays(events: DataFrame, beta: np.ndarray, horizon: float, paths: int = 1, min_mu: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mu, omega, lse) with the decays given: one pass over the data."""
    d = len(beta)
    mu, omega, lse = np.zeros(d), np.zeros((d, d)), np.zeros(d)
    low = np.r_[min_mu, np.zeros(d)]
    for k, (q, c) in enumerate(quadratic_terms(events, beta, horizon, paths)):
        x = bounded_quadratic(q, c, low)
        mu[k], omega[k], lse[k] = x[0], x[1:], loss(q, c, x)
    return mu, omega, lse


def fit_exponential(events: DataFrame, beta: np.ndarray, horizon: float, paths: int = 1, n_iter: int = 20, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(mu, omega, beta, log) with free decays: Adam on log beta, where mu and omega are always at their best.

    There the loss changes with the decays alone, so its gradient by them is that of the best loss; one scan a step gives both.
    """
    from pulsegrid.operators.marked import fit_marked  # which stands on this module

    got = fit_marked(events, np.asarray(beta, float), horizon=horizon, paths=paths, n_iter=n_iter, rate=rate)
    log = [(r["step"], np.reshape(r["beta"], got.beta.shape), r["loss"]) for r in got.log[:n_iter]]
    return got.level, got.omega, got.beta, log


def fit_bases(events: DataFrame, bases, n_bases: int, dims: int, horizon: float, paths: int = 1, min_mu: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mu, weights[k, j, basis], lse) of kernels that are sums of fixed bases with free weights: one pass over the pairs."""
    mu, weights, lse = np.zeros(dims), np.zeros((dims, dims, n_bases)), np.zeros(dims)
    for k, (q, c) in enumerate(basis_terms(events, bases, n_bases, dims, horizon, paths)):
        x = bounded_quadratic(q, c, np.r_[min_mu, np.zeros(dims * n_bases)])
        mu[k], weights[k], lse[k] = x[0], x[1:].reshape(dims, n_bases), loss(q, c, x)
    return mu, weights, lse


def start_near(mu: np.ndarray, omega: np.ndarray, beta: np.ndarray, spread: float = 0.2, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A start within a share ``spread`` of given parameters."""
    rng = np.random.default_rng(seed)
    return tuple(np.asarray(x, float) * rng.uniform(1 - spread, 1 + spread, np.shape(x)) for x in (mu, omega, beta))


def mixture_weights(n: int, total: float = 1.0, seed: int = 0) -> np.ndarray:
    """Uniform random weights of a simplex."""
    return np.random.default_rng(seed).dirichlet(np.ones(n)) * total


def random_start(dims: int, branching: float = 0.6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency with that spectral radius, uniform decays)."""
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 1, (dims, dims))
    return a * (branching / np.max(np.abs(np.linalg.eigvals(a)))), rng.uniform(0.5, 2.0, (dims, dims))


def feasible_start(eta: np.ndarray, branching: float = 0.6, seed: int = 0, tries: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A start whose stationary rates are ``eta``: mu = (I - A) eta, drawn until mu is positive."""
    rng = np.random.default_rng(seed)
    for _ in range(tries):
        a, beta = random_start(len(eta), branching * rng.uniform(0.2, 1), int(rng.integers(1 << 31)))
        mu = (np.eye(len(eta)) - a) @ eta
        if np.all(mu > 0):
            return mu, a, beta
    a = np.eye(len(eta)) * branching
    return (1 - branching) * eta, a, np.ones_like(a)
