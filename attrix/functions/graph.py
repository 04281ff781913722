"""Connected components of an edge table by alternating large and small stars
(Kiveris et al., 2014), as joins and aggregates only: no adjacency list is ever
gathered, so a hub with a third of all edges is one combined row a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.session import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    arcs = both if large else both.where("v < u")
    least = arcs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    near = arcs.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` (longs, any order) -> ``node, component``: the smallest node
    reachable, for every node with an edge.  Loops, nulls and repeats are
    ignored; it runs until nothing changes, however long the chains are."""
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")),
                             F.sum(F.col("v").cast("decimal(38,0)")),
                             F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = stash(_star(stash(_star(now, True), "large"), False), "small")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.withColumn("component", F.col("node")))
