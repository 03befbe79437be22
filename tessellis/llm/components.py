"""Connected components over written tables: every round ends in the shared folder, so lost executors cost one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellis.llm.common import discard, spread_join, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) of longs; component is the smallest node reachable.

    Large-star and small-star rounds by turns: both pull the neighbours of a node to the smallest among them, until
    every edge leads to its component's smallest node. Nodes with very many neighbours are cut into pieces. No edges give no rows; loops and repeated edges change nothing.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n"))
        large = spread_join(both, low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        after = written(small.filter("a <> b").distinct(), "edges")
        same = after.join(pairs, ["a", "b"], "left_anti").isEmpty() and pairs.join(after, ["a", "b"], "left_anti").isEmpty()
        discard(pairs)
        pairs = after
        if same:
            break
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
