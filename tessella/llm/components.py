"""Connected components of a graph that is only ever held as a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v): hangs the larger (or all smaller) neighbours of each u on the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    hung = near.join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of edges (u, v): label is the least node reachable.

    Large-star and small-star steps alternate until nothing changes; each round is a written table, so that plans stay
    short and a lost executor costs one round. Loops and repeated edges are ignored; no edges give no rows. Raises if
    max_rounds (logarithmic growth in the longest path) do not settle it.
    """
    now = stash(edges.where("u <> v").select("u", "v").distinct(), "edges", narrow=True)
    mark = None
    for _ in range(max_rounds):
        after = stash(_star(_star(now, True), False), "stars", narrow=True)
        seen = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        drop_stash(now)
        now = after
        if (seen["n"], seen["s"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = (seen["n"], seen["s"])
    raise RuntimeError("components did not settle")
