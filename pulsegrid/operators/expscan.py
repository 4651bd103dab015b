"""Exponential sums in linear time: S_m = sum over t_n < t_m of exp(-beta (t_m - t_n)) U_n, for any mix of decays.

Events are cut into blocks of time, and within a block the sums are a window's prefix sums of exp(beta (t_n - start)).  What
earlier blocks hand on is found over the table of block totals: blocks are gathered to spans of 4^p blocks, so long that a
decay of its own loses between e^-7.5 and e^-30 over one.  Within a span totals are a window's prefix sums again, and a span takes over what the few
before it hand on, as beyond them nothing is left that double precision can tell from zero.  So a decay of any size needs
no look further back than six spans, and an exponent is never over 30.  Decays that lose no more than that over a whole path have one span.

Decays whose sizes differ by up to ``SPREAD`` share their blocks, and so one shuffle of the events; slower ones, and sums without decay (beta = 0), take blocks of
their own with a few thousand events each.  Every window is bounded by a path and a block, or by the blocks of a path and a span.

Where no path has more than ``SPREAD`` events, nothing of this is needed: each sum follows from the one before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.kernels import Exponential
from pulsegrid.operators import blocks
from pulsegrid.operators.sums import intensity

col = F.col
LONGEST_PAIRED = 2_000
BLOCK_EXPONENT = 30.0
NEGLIGIBLE = 40.0
#: As many times a group's fastest decay may be its slowest; a span has no more blocks.
SPREAD = 4_096.0


def decay_groups(betas: Sequence[float], width: float, short: bool = False) -> list[tuple[float, list[int]]]:
    """(block width, indexes of decays): blocks no wider than ``width``, over which no decay of the group exceeds the exponent.

    Where all paths are ``short``, so are their tables of blocks, and all decays can share the blocks of the fastest.
    """
    order = sorted(range(len(betas)), key=lambda i: -betas[i])
    out: list[tuple[float, list[int]]] = []
    for i in order:
        own = min(width, BLOCK_EXPONENT / betas[i]) if betas[i] > 0 else width
        if out and (short or out[-1][0] == own or betas[i] * SPREAD >= betas[out[-1][1][0]]):
            out[-1][1].append(i)
        else:
            out.append((own, [i]))
    return out


def blocks_in_span(beta: float, width: float, span: float = math.inf) -> int:
    """The largest power of four of blocks over which the decay's exponent stays within its bound; 0 where a whole path does, which lasts no longer than ``span``."""
    if beta * (0 if beta == 0 else span + width) <= BLOCK_EXPONENT:
        return 0
    return 4 ** max(0, math.floor(math.log(BLOCK_EXPONENT / (beta * width) * (1 + 1e-12), 4)))


def _handed_on(totals: DataFrame, decays: dict[int, float], width: float, size: int) -> DataFrame:
    """(path_id, block, c_i ...): what the blocks before hand on to a block's start; ``totals`` has g_i, scaled to the blocks' starts."""
    rows = totals.withColumn("span", F.floor(col("block") / size) if size else F.lit(0).cast("long"))
    first = col("span") * size if size else F.min("block").over(Window.partitionBy("path_id", "span"))
    rows = rows.withColumn("at", (col("block") - first) * width)
    rows = rows.select("path_id", "block", "span", "at", *[(col(f"g{i}") * F.exp(b * col("at"))).alias(f"g{i}") for i, b in decays.items()])
    out = rows
    if size != 1:
        before = Window.partitionBy("path_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"p{i}": F.coalesce(F.sum(f"g{i}").over(before), F.lit(0.0)) for i in decays})
    if size:
        lost = width * size
        back = math.ceil(NEGLIGIBLE / (min(decays.values()) * lost))
        spans = rows.groupBy("path_id", "span").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in decays])
        spans = spans.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(back))))
        spans = spans.groupBy("path_id", (col("span") + col("r")).alias("span")).agg(*[F.sum(col(f"g{i}") * F.exp(-b * lost * col("r"))).alias(f"h{i}") for i, b in decays.items()])
        out = out.join(spans, ["path_id", "span"], "left")
    parts = lambda i: (col(f"p{i}") if size != 1 else F.lit(0.0)) + (F.coalesce(f"h{i}", F.lit(0.0)) if size else F.lit(0.0))
    return out.select("path_id", "block", *[(F.exp(-b * col("at")) * parts(i)).alias(f"c{i}") for i, b in decays.items()])


def exp_sums(events: DataFrame, terms: Sequence[tuple[float, Column]], names: Sequence[str], width: float | None = None) -> DataFrame:
    """Adds a column for each (beta, U): the decayed sum of U over the strict predecessors in the path.

    ``width`` bounds the blocks, so that a window holds a few thousand events; without it an aggregate finds it.
    """
    betas = [float(b) for b, _ in terms]
    short, span = False, math.inf
    if width is None:
        n, span = blocks.extent(events)
        width, short = blocks.width_of(n, span), n <= SPREAD
        if short:
            return _sums_of_short_paths(events, betas, [u for _, u in terms], names)
    rows = events
    for w, own in decay_groups(betas, width, short):
        rows = rows.withColumn("block", F.floor(col("t") / w)).withColumn("start", col("block") * w)
        rows = rows.withColumns({f"g{i}": (terms[i][1] * F.exp(betas[i] * (col("t") - col("start"))) if betas[i] else terms[i][1].cast("double")) for i in own})
        up_to = Window.partitionBy("path_id", "block").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        tied = Window.partitionBy("path_id", "block", "t")
        totals = rows.groupBy("path_id", "block").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in own])
        rows = rows.withColumns({f"p{i}": F.sum(f"g{i}").over(up_to) - F.sum(f"g{i}").over(tied) for i in own})
        sizes: dict[int, dict[int, float]] = {}
        for i in own:
            sizes.setdefault(blocks_in_span(betas[i], w, span), {})[i] = betas[i]
        held = None
        for size, decays in sizes.items():
            part = _handed_on(totals, decays, w, size)
            held = part if held is None else held.join(part, ["path_id", "block"])
        rows = rows.join(held, ["path_id", "block"])
        sums = {names[i]: F.exp(-betas[i] * (col("t") - col("start"))) * (col(f"p{i}") + col(f"c{i}")) for i in own}
        rows = rows.withColumns(sums).drop("block", "start", *[f"{x}{i}" for x in "gpc" for i in own])
    return rows


def _sums_of_short_paths(events: DataFrame, betas: Sequence[float], jumps: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """``exp_sums`` where no path is long: events meet by path, sorted by time, and each sum follows from the one before; paths of a batch go on side by side.

    Only the events are shuffled and sorted; what the terms add to a row is made after that and goes through a batch at a time.
    """
    own = list({id(u): u for u in jumps}.values())  # a jump that many decays share is sent once
    at = [next(i for i, x in enumerate(own) if x is u) for u in jumps]
    decays = sorted(set(betas))
    decay_of, decays = np.array([decays.index(b) for b in betas], dtype=int), np.array(decays)
    width, jumps_sent = len(events.columns), len(own)
    path_at, t_at = events.columns.index("path_id"), events.columns.index("t")
    names = list(names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, fresh, before = None, np.zeros(len(names)), np.zeros(len(names)), 0.0
        for b in it:
            n = b.num_rows
            if not n:
                continue
            paths, t = b.column(path_at).to_pylist(), b.column(t_at).to_numpy(zero_copy_only=False).astype(float)
            u = np.empty((n, jumps_sent))
            for i in range(jumps_sent):
                u[:, i] = b.column(width + i).fill_null(0.0).to_numpy(zero_copy_only=False)
            u = u[:, at]
            starts = np.array([i for i in range(n) if i == 0 or paths[i] != paths[i - 1]])
            lengths = np.diff(np.append(starts, n))
            goes_on = last is not None and paths[0] == last
            gap = np.diff(t, prepend=before)
            gap[starts[1 if goes_on else 0 :]] = 0.0
            later = (gap > 0)[:, None]
            lost = np.exp(-gap[:, None] * decays)[:, decay_of]
            out = np.empty((n, len(names)))
            order = np.argsort(-lengths, kind="stable")
            first, size = starts[order], lengths[order]
            # of the strictly earlier events, and of those at the time of the last one
            a, p = np.zeros((len(first), len(names))), np.zeros((len(first), len(names)))
            if goes_on:
                a[order == 0], p[order == 0] = held, fresh
            active = len(first)
            for r in range(size[0]):
                while size[active - 1] <= r:
                    active -= 1
                rows = first[:active] + r
                step = later[rows]
                a[:active] = (a[:active] + np.where(step, p[:active], 0.0)) * lost[rows]
                p[:active] = np.where(step, 0.0, p[:active]) + u[rows]
                out[rows] = a[:active]
            tail = np.flatnonzero(order == len(first) - 1)[0]
            last, held, fresh, before = paths[-1], a[tail].copy(), p[tail].copy(), t[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), *(pa.array(np.ascontiguousarray(x)) for x in out.T)], names=[*events_names, *names])

    events_names = list(events.columns)
    rows = events.where(col("path_id").isNotNull() & col("t").isNotNull()).repartition("path_id").sortWithinPartitions("path_id", "t")
    rows = rows.select("*", *[u.cast("double").alias(f"__u{i}") for i, u in enumerate(own)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema] + [T.StructField(n, T.DoubleType()) for n in names])
    return rows.mapInArrow(batches, schema)


def exp_intensity(events: DataFrame, mu: Sequence[float], omega: Sequence[Sequence[float]], beta: Sequence[Sequence[float]], impact=None) -> DataFrame:
    """(path_id, k, m, t, intensity) for exponential kernels, without pairs."""
    d = len(mu)
    u = lambda k, j: F.when(col("dim") == j, impact(F.lit(k), F.lit(j), col("mark")) if impact else F.lit(1.0)).otherwise(0.0)
    terms = [(beta[k][j], u(k, j)) for k in range(d) for j in range(d)]
    rows = exp_sums(events, terms, [f"s{k}_{j}" for k in range(d) for j in range(d)])
    value = F.lit(None).cast("double")
    for k in range(d):
        own = F.lit(float(mu[k]))
        for j in range(d):
            own = own + omega[k][j] * beta[k][j] * col(f"s{k}_{j}")
        value = F.when(col("dim") == k, own).otherwise(value)
    return rows.select("path_id", col("dim").alias("k"), col("event_id").alias("m"), "t", value.alias("intensity"))


def planned_intensity(events: DataFrame, mu: Sequence[float], omega: Sequence[Sequence[float]], beta: Sequence[Sequence[float]], longest: int = LONGEST_PAIRED) -> DataFrame:
    """``exp_intensity``, or the pair sum where no path has more than ``longest`` events, for which pairs are cheaper."""
    per_path = events.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))
    if (per_path.agg(F.max("n").alias("n")).first()["n"] or 0) > longest:
        return exp_intensity(events, mu, omega, beta)
    pick = lambda m, k, j: F.get(F.get(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m]), k), j)
    levels = F.array(*[F.lit(float(v)) for v in mu])
    return intensity(events, lambda k, j: Exponential(pick(omega, k, j), pick(beta, k, j)), lambda k, t: F.get(levels, k))


def exp_lag_sum(events: DataFrame, beta: float, lag: int) -> DataFrame:
    """(path_id, dim, total): sum of exp(-beta (t_m - t_{m - lag})) within a dimension."""
    w = Window.partitionBy("path_id", "dim").orderBy("t", "event_id")
    gap = col("t") - F.lag("t", lag).over(w)
    return events.withColumn("gap", gap).where("gap is not null").groupBy("path_id", "dim").agg(F.sum(F.exp(-beta * col("gap"))).alias("total"))


def exp_compensators(events: DataFrame, mu: Sequence[float], omega: Sequence[Sequence[float]], beta: Sequence[Sequence[float]]) -> DataFrame:
    """(path_id, k, m, t, compensator) for exponential kernels, without pairs.

    The excitation up to t is omega times the number of predecessors less their decayed sum.
    """
    d = len(mu)
    is_dim = [(col("dim") == j).cast("double") for j in range(d)]
    terms = [(beta[k][j], is_dim[j]) for k in range(d) for j in range(d)] + [(0.0, is_dim[j]) for j in range(d)]
    rows = exp_sums(events, terms, [f"s{k}_{j}" for k in range(d) for j in range(d)] + [f"n{j}" for j in range(d)])
    value = F.lit(None).cast("double")
    for k in range(d):
        own = F.lit(float(mu[k])) * col("t")
        for j in range(d):
            own = own + omega[k][j] * (col(f"n{j}") - col(f"s{k}_{j}"))
        value = F.when(col("dim") == k, own).otherwise(value)
    return rows.select("path_id", col("dim").alias("k"), col("event_id").alias("m"), "t", value.alias("compensator"))


def exp_double_sum_midpoint(events: DataFrame, beta: float, horizon: float) -> DataFrame:
    """(path_id, total): sum over pairs n < m of exp(-2 beta (T - (t_m + t_n) / 2)), which is a product of decays to the end, so a sum and its squares tell it.

    Events at equal times are pairs here, in either order once.
    """
    e = F.exp(-beta * (F.lit(horizon) - col("t")))
    per = events.groupBy("path_id").agg(F.sum(e).alias("s"), F.sum(e * e).alias("q"))
    return per.select("path_id", ((col("s") * col("s") - col("q")) / 2).alias("total"))


def updated_exp_sum(total: Column, gap: Column, beta: float, jump: Column | float = 1.0) -> Column:
    """A decayed sum after a further ``gap`` of time and then an event."""
    return total * F.exp(-beta * gap) + jump
