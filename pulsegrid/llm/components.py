"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage

ROWS_PER_TASK = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour is hung on the smallest of the neighbourhood."""
    near = _both_ways(edges).coalesce(parts)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct()


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every smaller neighbour, and the node itself, is hung on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v); the root is the component's least node.

    Self-links are dropped.  Every round is written to the checkpoint folder; sums tell when
    nothing changes.  The result has no row for a root itself.  A table gets a partition for each
    ``ROWS_PER_TASK`` rows, so that a small one is not shuffled in hundreds of empty pieces.
    """
    edges = cut_lineage(links.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or not seen["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        parts = 1 + seen["n"] // ROWS_PER_TASK
        edges = cut_lineage(_small_star(cut_lineage(_large_star(edges, parts)), parts))
