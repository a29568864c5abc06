"""Connected components by alternating stars, for links between near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours on one side of each node are linked to the least node of its neighbourhood."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Stored, so that the join is one of two plain shuffles, which can split the many edges of one node.
    least = stored(around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    linked = around.join(least, "a")
    if large:
        made = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return made.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node of some edge (a, b).

    Each step is written to the shared folder; the number of steps grows with
    the logarithm of the longest chain.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        now = stored(_star(_star(now, large=True), large=False), "edges")
        then, seen = seen, _state(now)
        if then == seen:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.groupBy("node").agg(F.min("component").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
