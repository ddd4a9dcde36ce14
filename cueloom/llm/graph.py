"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import shared_table

#: Edges a partition of a written table aims at; few edges need not be dealt over all shuffle partitions.
EDGES_A_PART = 500_000


def _contract(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Hang the larger (or, of a node's own, the smaller) neighbours of each node on the least of its neighbourhood.

    The least neighbour is a partial aggregate and the join splits on skew, so a hub is no single task's work.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = shared_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")).coalesce(parts))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return shared_table(out.where("u <> v").distinct().coalesce(parts))


def _open_nodes(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one and has others itself: then the edges are not yet stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return bool(sums.where("hangs > 1 or (hangs = 1 and holds = 1)").take(1))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v): component is the least node reachable.

    Loops, repeated edges and nulls are ignored; without edges the result is empty.
    """
    least = edges.sparkSession.sparkContext.defaultParallelism
    now = shared_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while _open_nodes(now):
        parts = max(least, now.count() // EDGES_A_PART)
        now = _contract(_contract(now, True, parts), False, parts)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v"), F.col("v")).distinct())
