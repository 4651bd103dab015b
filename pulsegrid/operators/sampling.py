"""Samples of pairs by index, placed once and drawn on the executors, and gradients of the least-squares loss from them.

A pair is a place: the rows (event, source type) of ``kappa`` have one pair for each lag up to kappa + 1, a stratum is a band of lags, and a row's
pairs of a stratum follow those of the rows before it.  Rows are dealt by hash into buckets of bounded size; where a row begins in its bucket is a window's
running count, and where a bucket begins in a stratum is a running count over the buckets, by groups of them.  All this is made
once, and every draw reuses it.

The k-th drawn place of a stratum is a seeded permutation of its places, taken at k: a Feistel network on the next power of four, walked on until it falls into
the stratum.  So draws are rows of a range, without replacement and without a list in the driver, and they are the same whatever executors come and go.

A gradient from a sample is unbiased: sums over single events are exact, sums over pairs are stratum means times sizes.  Draws are dealt to the strata by size and by the
root of the summed variances of all its components, which earlier steps have shown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.impacts import Family
from pulsegrid.operators import blocks, marked
from pulsegrid.operators.fit import Adam, Schedule
from pulsegrid.operators.storage import cut_lineage
from pulsegrid.operators.strata import augmented, lag_strata, neyman_allocation, smoothed, stratum_moments, sum_of_strata

col = F.col
ROWS_IN_BUCKET = 256
BUCKETS_IN_GROUP = 1_024
ROUNDS = 6
#: So many drawn places are sent to the rows and events; more meet them by a shuffle.
MAX_BROADCAST_DRAWN = 100_000
#: Steps of the walk; each ends it with probability over 1 / 4, so it is longer with probability under 1e-31.
WALK = 250


def permuted(k: Column, size: Column, seed: Column) -> Column:
    """The place of ``k`` in a seeded permutation of 0 .. size - 1, for sizes up to 2^60."""
    half = F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double")) / 2), F.lit(1)).cast("int")
    shift = lambda x, n: F.call_function("shiftleft", x, n)
    mask = shift(F.lit(1).cast("long"), half) - 1

    def once(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(s["r"], i, seed).bitwiseAND(mask)).alias("r"))

        start = F.struct(F.call_function("shiftright", x, half).alias("l"), x.bitwiseAND(mask).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: shift(s["l"], half).bitwiseOR(s["r"]))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(F.lit(False).alias("ok"), k.cast("long").alias("x")), lambda s, _: F.when(s["ok"], s).otherwise(_walked(once(s["x"]), size)))
    return steps["x"]


def _walked(x: Column, size: Column) -> Column:
    held = F.transform(F.array(x), lambda y: F.struct((y < size).alias("ok"), y.alias("x")))  # so that a step is evaluated once
    return F.get(held, F.lit(0))


@dataclass
class PairPlaces:
    """All pairs of a data set, or all its single events, as places; ``sizes`` by stratum."""

    events: DataFrame  # ranked
    rows: DataFrame  # path_id, i, m, j, kappa, bucket, counts, starts
    offsets: DataFrame  # group, bucket, stratum, at: where the bucket's pairs of the stratum begin
    groups: DataFrame  # group, stratum, at
    strata: list[tuple[int, int]]
    sizes: dict[int, int]

    def indices(self, allocation: dict[int, int], seed: int) -> DataFrame:
        """(stratum, path_id, i, m, j, h, n) of exactly min(q, size) places of each stratum: the n-th event of type j, h back from m."""
        taken = {s: min(q, self.sizes[s]) for s, q in allocation.items() if q > 0 and s in self.sizes}
        whole = [s for s, q in taken.items() if q == self.sizes[s]]
        part = {s: q for s, q in taken.items() if q < self.sizes[s]}
        if not part:
            return self._whole(whole) if whole else self._whole([0]).where(F.lit(False))
        drawn = self._drawn(part, seed)
        drawn = cut_lineage(self._whole(whole).unionByName(drawn) if whole else drawn)
        return F.broadcast(drawn) if sum(taken.values()) <= MAX_BROADCAST_DRAWN else drawn

    def _whole(self, strata: list[int]) -> DataFrame:
        """All places of these strata, straight from the rows."""
        each = F.array(*[F.struct(F.lit(s).alias("stratum"), F.lit(self.strata[s][0]).cast("long").alias("low"), F.get(col("counts"), F.lit(s)).alias("count")) for s in strata])
        found = self.rows.select("path_id", "i", "m", "j", "kappa", F.inline(F.filter(each, lambda x: x["count"] > 0)))
        found = found.select("stratum", "path_id", "i", "m", "j", "kappa", F.explode(F.sequence(col("low"), col("low") + col("count") - 1)).alias("h"))
        return found.select("stratum", "path_id", "i", "m", "j", "h", (col("kappa") - col("h") + 1).alias("n"))

    def _drawn(self, allocation: dict[int, int], seed: int) -> DataFrame:
        """The drawn places of strata that are not taken whole."""
        spark = self.events.sparkSession
        plan, total = [], 0
        for s, q in allocation.items():
            plan.append((s, total, self.sizes[s]))
            total += q
        own = F.array(*[F.struct(F.lit(s).alias("stratum"), F.lit(at).cast("long").alias("at"), F.lit(size).cast("long").alias("size")) for s, at, size in plan])
        picks = spark.range(0, total, 1, max(1, total // 10_000)).select("id", F.element_at(F.filter(own, lambda x: x["at"] <= col("id")), -1).alias("x"))
        picks = picks.select("x.stratum", permuted(col("id") - col("x.at"), col("x.size"), F.xxhash64(F.lit(seed), col("x.stratum"))).alias("place"))
        picks = cut_lineage(picks)
        small = total <= MAX_BROADCAST_DRAWN

        def located(picks: DataFrame, table: DataFrame, keys: list[str], name: str) -> DataFrame:
            """Each pick with the last ``name`` of the table that begins at or before its place."""
            more = [c for c in picks.columns if c not in (*keys, "place")]
            both = table.select(*keys, col("at").alias("place"), F.lit(0).alias("side"), name, *[F.lit(None).cast(picks.schema[c].dataType).alias(c) for c in more])
            both = both.unionByName(picks.select(*keys, "place", F.lit(1).alias("side"), F.lit(None).cast(table.schema[name].dataType).alias(name), *more))
            w = Window.partitionBy(*keys).orderBy("place", "side", name).rowsBetween(Window.unboundedPreceding, 0)
            return both.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("side = 1").drop("side")

        picks = located(picks, self.groups, ["stratum"], "group")
        picks = located(picks, self.offsets, ["stratum", "group"], "bucket")
        picks = picks.join(self.offsets.select("stratum", "bucket", "at"), ["stratum", "bucket"]).withColumn("place", col("place") - col("at"))
        start, count = F.get(col("starts"), col("stratum")), F.get(col("counts"), col("stratum"))
        picks = picks.select("bucket", "stratum", "place")
        found = self.rows.join(F.broadcast(picks) if small else picks, "bucket").where((col("place") >= start) & (col("place") < start + count))
        low = F.array(*[F.lit(lo).cast("long") for lo, _ in self.strata])
        h = F.get(low, col("stratum")) + col("place") - start
        return found.select("stratum", "path_id", "i", "m", "j", h.alias("h"), (col("kappa") - h + 1).alias("n"))

    def draw(self, allocation: dict[int, int], seed: int) -> DataFrame:
        """(stratum, path_id, i, m, j, h, t, dt, mark, mark_m) of exactly min(q, size) pairs of each stratum."""
        found = self.indices(allocation, seed)
        later = self.events.select("path_id", col("dim").alias("i"), "m", "t", col("mark").alias("mark_m"))
        earlier = self.events.select("path_id", col("dim").alias("j"), col("m").alias("n"), col("t").alias("t_n"), "mark")
        both = found.join(later, ["path_id", "i", "m"]).join(earlier, ["path_id", "j", "n"])
        return both.select("stratum", "path_id", "i", "m", "j", "h", "t", (col("t") - col("t_n")).alias("dt"), "mark", "mark_m")

    def draw_single(self, allocation: dict[int, int], seed: int) -> DataFrame:
        """(stratum, path_id, j, h, t, mark) of exactly min(q, size) events of each stratum; h is 1 for the last of its path and type."""
        found = self.indices(allocation, seed).select("stratum", "path_id", "j", "h", col("n").alias("m"))
        return found.join(self.events.select("path_id", col("dim").alias("j"), "m", "t", "mark"), ["path_id", "j", "m"])


def place_pairs(events: DataFrame, dims: int, strata: list[tuple[int, int]] | None = None, seed: int = 3) -> PairPlaces:
    """Ranks the events, counts the pairs of all strata and writes where they stand; nothing of it depends on a model."""
    width = blocks.block_width(events)
    return _placed(cut_lineage(blocks.ranked(events, width)), cut_lineage(blocks.kappa(events, dims, width).where("kappa >= 0")), strata or lag_strata(1 << 40), seed)


def place_singles(events: DataFrame, strata: list[tuple[int, int]] | None = None, seed: int = 3) -> PairPlaces:
    """The same for single events, by how many of their path and type stand at or after them: an event is a pair with its path's end."""
    ranked = cut_lineage(blocks.ranked(events, blocks.block_width(events)))
    ends = ranked.groupBy("path_id", col("dim").alias("i")).agg(F.count(F.lit(1)).alias("m"))
    ends = cut_lineage(ends.select("path_id", "i", "m", col("i").alias("j"), (col("m") - 1).alias("kappa")))
    return _placed(ranked, ends, strata or lag_strata(1 << 40), seed)


def _placed(ranked: DataFrame, kappas: DataFrame, strata: list[tuple[int, int]], seed: int) -> PairPlaces:
    n = len(strata)
    buckets = max(1, -(-kappas.count() // ROWS_IN_BUCKET))
    rows = kappas.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "path_id", "i", "m", "j"), F.lit(buckets)))
    rows = rows.withColumns({f"c{s}": F.greatest(F.least(F.lit(high).cast("long"), col("kappa") + 1) - (low - 1), F.lit(0)) for s, (low, high) in enumerate(strata)})
    totals = cut_lineage(rows.groupBy("bucket").agg(*[F.sum(f"c{s}").alias(f"c{s}") for s in range(n)]))
    w = Window.partitionBy("bucket").orderBy("path_id", "i", "m", "j").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.array(*[F.sum(f"c{s}").over(w) - col(f"c{s}") for s in range(n)])
    rows = rows.select("path_id", "i", "m", "j", "kappa", "bucket", F.array(*[col(f"c{s}") for s in range(n)]).alias("counts"), starts.alias("starts"))
    each = totals.select("bucket", F.floor(col("bucket") / BUCKETS_IN_GROUP).alias("group"), F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), col(f"c{s}").alias("n")) for s in range(n)])).alias("x"))
    each = each.select("bucket", "group", "x.stratum", "x.n").where("n > 0")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    per_group = each.groupBy("stratum", "group").agg(F.sum("n").alias("n"))
    groups = cut_lineage(per_group.select("stratum", "group", "n", F.coalesce(F.sum("n").over(before("stratum").orderBy("group")), F.lit(0)).alias("at")))
    offsets = each.withColumn("here", F.coalesce(F.sum("n").over(before("stratum", "group").orderBy("bucket")), F.lit(0)))
    offsets = offsets.join(groups.select("stratum", "group", "at"), ["stratum", "group"]).select("stratum", "group", "bucket", (col("at") + col("here")).alias("at"))
    sizes = {r["stratum"]: int(r["n"]) for r in groups.groupBy("stratum").agg(F.sum("n").alias("n")).collect()}  # a row for each stratum
    return PairPlaces(ranked, cut_lineage(rows), cut_lineage(offsets), groups, strata, sizes)


@dataclass
class SampledGradient:
    """By name (level, slope, omega, beta, theta): the estimate and its variance; ``spread`` by stratum, for the next allocation.

    A component's variance allows for one unseen pair in each stratum, as large as the largest that any component of its name has met there.
    """

    value: dict[str, np.ndarray]
    variance: dict[str, np.ndarray]
    spread: dict[int, float]


def sampled_gradient(
    places: PairPlaces, allocation: dict[int, int], seed: int, level: np.ndarray, omega: np.ndarray, beta: np.ndarray, horizon: float, paths: int = 1, slope: np.ndarray | None = None, impact: Family | None = None, theta: np.ndarray | None = None
) -> SampledGradient:
    """The gradient of the loss of ``marked.scan_sums`` from exact single sums and a sample of the pairs."""
    d = len(level)
    theta = np.zeros((d, d)) if theta is None else np.asarray(theta, float)
    slope = np.zeros(d) if slope is None else slope
    base = marked.single_sums(places.events, beta, horizon, paths, impact, theta)
    _, exact = base.loss_and_gradient(level, slope, omega)
    total = base.moments[0]
    pick = lambda m, k, j: F.get(F.get(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m]), k), j)
    u = lambda p, x: impact.value(p, col(x)) if impact else F.lit(1.0)
    v = lambda p, x: impact.slope(p, col(x)) if impact else F.lit(0.0)
    drawn = places.draw(allocation, seed).withColumn("pair", F.monotonically_increasing_id())
    each = drawn.select("*", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("k"))
    each = each.withColumns({f"{name}{x}": pick(m, col("k"), col(x)) for name, m in (("w", omega), ("b", beta), ("p", theta)) for x in "ij"})
    each = each.withColumns({"ui": u(col("pi"), "mark_m"), "vi": v(col("pi"), "mark_m"), "uj": u(col("pj"), "mark"), "vj": v(col("pj"), "mark")})
    wi, wj, bi, bj, dt, left = col("wi"), col("wj"), col("bi"), col("bj"), col("dt"), F.lit(float(horizon)) - col("t")
    both, s, end = bi + bj, F.exp(-bj * dt), F.exp(-(bi + bj) * left)
    g, m = bi * bj / both, 1 - end
    late, early = bj / both * (bj / both) * m + g * left * end, bi / both * (bi / both) * m + g * left * end - g * m * dt
    ui, vi, uj, vj, hit = col("ui"), col("vi"), col("uj"), col("vj"), F.when(col("k") == col("i"), 1.0).otherwise(0.0)
    later = {"omega": wj * g * m * ui * uj * s, "beta": wi * wj * ui * uj * s * late, "theta": wi * wj * g * m * vi * uj * s}
    earlier = {
        "omega": wi * g * m * ui * uj * s - hit * bj * uj * s, "beta": wi * wj * ui * uj * s * early - hit * wj * (1 - bj * dt) * s * uj, "theta": wi * wj * g * m * ui * vj * s - hit * wj * bj * s * vj,
    }
    cells = [F.struct(F.lit(n).alias("name"), col(x).alias("c"), (2 * part[n] / total).alias("x")) for part, x in ((later, "i"), (earlier, "j")) for n in part]
    cells = each.select("stratum", "pair", "k", F.inline(F.array(*cells))).groupBy("stratum", "pair", "name", "k", "c").agg(F.sum("x").alias("x"))
    sums = cells.groupBy("stratum", "name", "k", "c").agg(F.sum("x").alias("s"), F.sum(col("x") * col("x")).alias("q"), F.max(F.abs("x")).alias("most")).collect()  # numbers of strata and parameters
    value = {n: np.array(x) for n, x in exact.items()}
    variance = {n: np.zeros_like(x) for n, x in exact.items()}
    spread: dict[int, float] = {}
    most: dict[tuple[int, str], float] = {}
    for r in sums:
        n, q = places.sizes[r["stratum"]], min(allocation[r["stratum"]], places.sizes[r["stratum"]])
        var = max(0.0, (r["q"] - r["s"] ** 2 / q) / (q - 1)) if q > 1 else 0.0
        value[r["name"]][r["k"], r["c"]] += n * r["s"] / q
        variance[r["name"]][r["k"], r["c"]] += n * n * (1 - q / n) * var / q
        most[r["stratum"], r["name"]] = max(most.get((r["stratum"], r["name"]), 0.0), r["most"])
        spread[r["stratum"]] = spread.get(r["stratum"], 0.0) + var
    for (s, name), x in most.items():  # a pair that no draw has met may add to any component of its name
        n, q = places.sizes[s], min(allocation[s], places.sizes[s])
        variance[name] += n * n * (1 - q / n) * augmented(0.0, x, q) / q
    return SampledGradient(value, variance, {s: math.sqrt(x) for s, x in spread.items()})


def fit_sampled(
    events: DataFrame, level: np.ndarray, omega: np.ndarray, beta: np.ndarray, horizon: float, paths: int = 1, *, budget: int = 10_000, n_iter: int = 50, solver=None, seed: int = 3, impact: Family | None = None, theta: np.ndarray | None = None, strata=None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """(level, omega, beta, theta, log) after ``n_iter`` stochastic steps, each on a fresh sample of ``budget`` pairs; placed once."""
    d = len(level)
    places = place_pairs(events, d, strata, seed)
    theta = np.zeros((d, d)) if theta is None else np.array(theta, float)
    solver, seen, log = solver or Adam(Schedule(0.05)), {}, []
    x = np.r_[level, np.ravel(omega), np.log(np.ravel(beta)), np.ravel(theta)]
    low = np.r_[np.full(d, 1e-10), np.zeros(d * d), np.full(d * d, -np.inf), np.full(d * d, impact.low if impact else 0.0)]
    cut = lambda x: (x[:d], x[d : d + d * d].reshape(d, d), np.exp(x[d + d * d : d + 2 * d * d]).reshape(d, d), x[d + 2 * d * d :].reshape(d, d))
    for t in range(n_iter):
        c, w, b, p = cut(x)
        allocation = neyman_allocation(places.sizes, seen, budget)
        got = sampled_gradient(places, allocation, seed + 1 + t, c, w, b, horizon, paths, None, impact, p)
        seen = smoothed(seen, got.spread)
        step = np.r_[got.value["level"], np.ravel(got.value["omega"]), np.ravel(got.value["beta"] * b), np.ravel(got.value["theta"])]
        log.append({"step": t, "gradient_norm": float(np.linalg.norm(step)), "x": x.copy()})
        x = np.maximum(solver.step(x, step, t), low)
    return *cut(x), log


@dataclass(frozen=True)
class Domains:
    """Which strata are summed whole, sampled by their deviations, and sampled by their sizes alone: the first ``exact``, the next ``adaptive``, the others.

    Near strata decide a sum with a decaying summand, so they are worth all their terms or an adapted share; far ones, where little changes, are not.
    """

    exact: int = 5
    adaptive: int = 20
    adaptive_budget: int = 10_000
    plain_budget: int = 10_000

    def split(self, sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
        own = sorted(sizes)
        part = lambda low, high: {s: sizes[s] for s in own if low <= s < high}
        return part(0, self.exact), part(self.exact, self.exact + self.adaptive), part(self.exact + self.adaptive, len(own) + max(own, default=0) + 1)


def estimated_sums(places: PairPlaces, values: dict[str, Column], domains: Domains, *, single: bool = False, rounds: int = 2, seed: int = 11) -> DataFrame:
    """(name, total, variance, size, drawn) of the sums of ``values`` over all places, from the three domains.

    The first round of the adaptive domain goes by size, the others by what the rounds before have shown: by the deviations of all values, each in units of its largest.
    """
    spark = places.events.sparkSession
    whole, adaptive, plain = domains.split(places.sizes)
    drawn_by = places.draw_single if single else places.draw
    shares = neyman_allocation(plain, {}, domains.plain_budget) if plain else {}
    best, seen = (neyman_allocation(adaptive, {}, domains.adaptive_budget) if adaptive else {}), {}
    for r in range(rounds if adaptive else 0):
        got = drawn_by(best, seed + r).groupBy("stratum").agg(*[F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(values.values())]).collect()  # a row for each stratum
        most = [max((x[f"s{i}"] for x in got), default=0.0) or 1.0 for i in range(len(values))]
        seen = smoothed(seen, {x["stratum"]: math.hypot(*[x[f"s{i}"] / m for i, m in enumerate(most)]) for x in got})
        best = neyman_allocation(adaptive, seen, domains.adaptive_budget)
    parts = [drawn_by(x, seed + rounds) for x in (whole, {**best, **shares}) if x]
    sample = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    one = lambda v, i: [x.alias(f"{x_name}{i}") for x_name, x in stratum_moments(v).items()]
    per = cut_lineage(sample.groupBy("stratum").agg(*[x for i, v in enumerate(values.values()) for x in one(v, i)]))  # a row for each stratum
    sizes = spark.createDataFrame(list(places.sizes.items()), "stratum int, size long")
    drawn = sum(whole.values()) + sum(min(q, places.sizes[s]) for s, q in {**best, **shares}.items())
    out = None
    for i, name in enumerate(values):
        own = per.select("stratum", *[col(f"{c}{i}").alias(c) for c in ("mean", "var", "q", "most")])
        row = sum_of_strata(own, sizes).select(F.lit(name).alias("name"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("variance", F.lit(0.0)).alias("variance"), F.lit(sum(places.sizes.values())).cast("long").alias("size"), F.lit(drawn).cast("long").alias("drawn"))
        out = row if out is None else out.unionByName(row)
    return out


def adaptive_pair_sum(events: DataFrame, dims: int, strata: list[tuple[int, int]], values: dict[str, Column], budget: int, rounds: int = 2, seed: int = 3) -> DataFrame:
    """(name, total, variance, size) of the sums of ``values`` (of dt, t, i, j, mark and mark_m) over all pairs, all strata adaptive.

    Strata with no more pairs than their share of the budget are taken whole, so they add no variance.
    """
    places = place_pairs(events, dims, strata, seed)
    return estimated_sums(places, values, Domains(0, len(strata), budget, 0), rounds=rounds, seed=seed).drop("drawn")
