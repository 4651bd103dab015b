"""Structured Streaming: windowed rates with late data, and online exponential intensities with state."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rates(stream: DataFrame, *, window: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Counts for each dimension and tumbling window; events later than ``late`` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), "dim").agg(F.count(F.lit(1)).alias("n"))


def online_intensity(stream: DataFrame, mu: Sequence[float], omega: Sequence[Sequence[float]], beta: Sequence[Sequence[float]]) -> DataFrame:
    """(path_id, k, m, t, intensity) of events (path_id, event_id, dim, t) as they come; a path's micro-batches must be in order of time.

    The state of a path is its last time and a decayed sum for each pair of dimensions, so each event costs the same.
    """
    d = len(mu)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sums = (state.get[0], list(state.get[1])) if state.exists else (0.0, [0.0] * (d * d))
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = []
        for t, same in rows.groupby("t", sort=True):
            sums = [s * math.exp(-beta[i // d][i % d] * (t - last)) for i, s in enumerate(sums)]
            last = float(t)
            for k, m in zip(same["dim"], same["event_id"], strict=True):
                out.append((key[0], int(k), int(m), last, mu[k] + sum(omega[k][j] * beta[k][j] * sums[k * d + j] for j in range(d))))
            for j in same["dim"]:
                for k in range(d):
                    sums[k * d + j] += 1.0
        state.update((last, sums))
        yield pd.DataFrame(out, columns=["path_id", "k", "m", "t", "intensity"])

    return stream.groupBy("path_id").applyInPandasWithState(update, "path_id long, k int, m long, t double, intensity double", "last double, sums array<double>", "append", GroupStateTimeout.NoTimeout)
