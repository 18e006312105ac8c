"""Connected components of a graph of many edges, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for each node of ``edges``
    (``a``, ``b``; undirected). Large and small stars in turn: every round points nodes to the
    least neighbour they know, until nothing changes. A node with very many neighbours is
    counted in parts (partial minimum) and its join is split by AQE."""
    now = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "component-edges")
    state = None
    while True:
        # large star: larger neighbours of a node go to the least of node and neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = kept(moved.unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "component-edges")
        found = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if found == state:
            break
        state, now = found, following
    roots = now.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
