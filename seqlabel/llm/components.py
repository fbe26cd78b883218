"""Connected components of an edge table by alternating star contractions.

Each round links every node's larger neighbours to its smallest neighbour
(large star), then every node and its smaller neighbours to the smallest of
them (small star); the edge set shrinks to one star per component.  All steps
are min-aggregations and equi-joins on node ids, so a star with any number of
neighbours is never collected into one task: the aggregate is partial, the join
sides are written tables whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(edges: DataFrame) -> DataFrame:
    """Both stars of one round over directed edges (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # a node that is its own minimum keeps its larger neighbours; the others hand theirs on
    large = saved(large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), "star")
    least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "star")
    small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); ``root`` is the smallest
    node of its component.  Loops and repeated edges are harmless; no edges, no
    rows.  Rounds run until an edge set is a fixed point, about the logarithm of
    the longest shortest path."""
    edges = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    seen = None
    while True:
        # a star forest: every node has one edge, and no root is below another node
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            break
        seen, edges = state, _star(edges)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
