"""Pair sums, intensities, losses and residuals of linear Hawkes models.

A model is a function of the receiving and the source dimension: ``kernel(k, j)`` gives a kernel whose
parameters may be Columns of k and j, so that one plan serves all pairs of dimensions.  Pairs are an
equi-join on the path with a strict inequality in time.  For long paths, ``receivers`` salts the
receiving side: each receiver's sum is independent of the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.kernels import Kernel

col = F.col
KernelOf = Callable[[Column, Column], Kernel]


def pairs(events: DataFrame, salts: int = 1) -> DataFrame:
    """(path_id, k, m, t, dt, j, mark, mark_m) of every event with each of its strict predecessors.

    With ``salts`` > 1 the receivers of a path are dealt over that many tasks and its sources copied to each.
    """
    later = events.select("path_id", col("event_id").alias("m"), col("dim").alias("k"), "t", col("mark").alias("mark_m"))
    earlier = events.select("path_id", col("dim").alias("j"), col("t").alias("t_n"), "mark")
    keys = ["path_id"]
    if salts > 1:
        later = later.withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(salts)))
        earlier = earlier.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        keys.append("salt")
    return later.join(earlier, keys).where("t_n < t").withColumn("dt", col("t") - col("t_n"))


def intensity(events: DataFrame, kernel: KernelOf, mu: Callable[[Column, Column], Column], impact: Callable[[Column, Column, Column], Column] | None = None, salts: int = 1) -> DataFrame:
    """(path_id, k, m, t, intensity) at every event: mu(k, t) + sum of phi(dt) * impact(k, j, mark) over the predecessors."""
    p = pairs(events, salts)
    phi = kernel(col("k"), col("j")).phi(col("dt"))
    if impact:
        phi = phi * impact(col("k"), col("j"), col("mark"))
    sums = p.groupBy("m").agg(F.sum(phi).alias("excited"))
    rows = events.select("path_id", col("dim").alias("k"), col("event_id").alias("m"), "t")
    return rows.join(sums, "m", "left").select("path_id", "k", "m", "t", (mu(col("k"), col("t")) + F.coalesce("excited", F.lit(0.0))).alias("intensity"))


def psi_sums(events: DataFrame, kernel: KernelOf, dims: int, horizon: float, impact=None) -> DataFrame:
    """(k, j, psi): sum over type-j events of psi_kj(T - t) * impact."""
    rows = events.select("dim", "t", "mark", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("k"))
    value = kernel(col("k"), col("dim")).psi(F.lit(horizon) - col("t"))
    if impact:
        value = value * impact(col("k"), col("dim"), col("mark"))
    return rows.groupBy("k", col("dim").alias("j")).agg(F.sum(value).alias("psi"))


def upsilon_zero_sums(events: DataFrame, kernel: KernelOf, dims: int, horizon: float, impact=None) -> DataFrame:
    """(k, j, upsilon): sum of upsilon_jjk(T - t, 0) * impact^2."""
    rows = events.select("dim", "t", "mark", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("k"))
    own = kernel(col("k"), col("dim"))
    value = own.upsilon(own, F.lit(horizon) - col("t"), F.lit(0.0))
    if impact:
        value = value * F.pow(impact(col("k"), col("dim"), col("mark")), 2)
    return rows.groupBy("k", col("dim").alias("j")).agg(F.sum(value).alias("upsilon"))


def phi_sums(pair: DataFrame, kernel: KernelOf, impact=None) -> DataFrame:
    """(k, j, phi): sum over the pairs of a type-k event with a type-j predecessor."""
    value = kernel(col("k"), col("j")).phi(col("dt"))
    if impact:
        value = value * impact(col("k"), col("j"), col("mark"))
    return pair.groupBy("k", "j").agg(F.sum(value).alias("phi"))


def upsilon_sums(pair: DataFrame, kernel: KernelOf, dims: int, horizon: float, impact=None) -> DataFrame:
    """(k, i, j, upsilon): sum of upsilon_ijk(T - t_m, dt); i is the later event's dimension."""
    rows = pair.select(col("k").alias("i"), "j", "t", "dt", "mark", "mark_m", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("k"))
    value = kernel(col("k"), col("i")).upsilon(kernel(col("k"), col("j")), F.lit(horizon) - col("t"), col("dt"))
    if impact:
        value = value * impact(col("k"), col("i"), col("mark_m")) * impact(col("k"), col("j"), col("mark"))
    return rows.groupBy("k", "i", "j").agg(F.sum(value).alias("upsilon"))


def least_squares(events: DataFrame, kernel: KernelOf, mu: Callable[[Column], Column], dims: int, horizon: float, paths: int = 1) -> DataFrame:
    """(k, lse): the least-squares loss with constant baselines, for ``paths`` paths over [0, T] each; a mean over the paths.

    mu^2 - 2 eta mu + (2 mu sum psi + sum upsilon0 + 2 sum upsilon - 2 sum phi) / T.
    """
    p = pairs(events)
    total = F.lit(float(horizon * paths))
    parts = [
        psi_sums(events, kernel, dims, horizon).select("k", (2 * mu(col("k")) * col("psi") / total).alias("x")),
        upsilon_zero_sums(events, kernel, dims, horizon).select("k", (col("upsilon") / total).alias("x")),
        upsilon_sums(p, kernel, dims, horizon).select("k", (2 * col("upsilon") / total).alias("x")),
        phi_sums(p, kernel).select("k", (-2 * col("phi") / total).alias("x")),
        events.groupBy(col("dim").alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k", (-2 * mu(col("k")) * col("n") / total).alias("x")),
        events.sparkSession.range(dims).select(col("id").cast("int").alias("k"), (mu(col("id")) * mu(col("id"))).alias("x")),
    ]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy("k").agg(F.sum("x").alias("lse"))


def log_likelihood(intensities: DataFrame, events: DataFrame, kernel: KernelOf, mu: Callable[[Column], Column], dims: int, horizon: float, paths: int = 1) -> DataFrame:
    """(k, loglik): sum of log intensity less the whole compensator, baseline and excitation."""
    logs = intensities.groupBy("k").agg(F.sum(F.log("intensity")).alias("logs"))
    excited = psi_sums(events, kernel, dims, horizon).groupBy("k").agg(F.sum("psi").alias("psi"))
    out = events.sparkSession.range(dims).select(col("id").cast("int").alias("k")).join(logs, "k", "left").join(excited, "k", "left")
    return out.select("k", (F.coalesce("logs", F.lit(0.0)) - mu(col("k")) * float(horizon * paths) - F.coalesce("psi", F.lit(0.0))).alias("loglik"))


def compensators(events: DataFrame, kernel: KernelOf, baseline: Callable[[Column, Column], Column], impact=None, salts: int = 1) -> DataFrame:
    """(path_id, k, m, t, compensator): the integral of the intensity up to each event."""
    p = pairs(events, salts)
    psi = kernel(col("k"), col("j")).psi(col("dt"))
    if impact:
        psi = psi * impact(col("k"), col("j"), col("mark"))
    sums = p.groupBy("m").agg(F.sum(psi).alias("excited"))
    rows = events.select("path_id", col("dim").alias("k"), col("event_id").alias("m"), "t")
    return rows.join(sums, "m", "left").select("path_id", "k", "m", "t", (baseline(col("k"), col("t")) + F.coalesce("excited", F.lit(0.0))).alias("compensator"))


def residuals(compensator: DataFrame) -> DataFrame:
    """(path_id, k, m, residual): differences of the compensator between events of one dimension."""
    w = Window.partitionBy("path_id", "k").orderBy("t", "m")
    out = compensator.withColumn("residual", col("compensator") - F.lag("compensator").over(w))
    return out.where("residual is not null").select("path_id", "k", "m", "residual")
