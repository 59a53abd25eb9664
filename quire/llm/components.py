"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._rounds import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of each node with an edge to another; edges: columns a, b.

    Alternates two steps until the edges stand still: every node links its
    larger neighbours to its least one, then its smaller ones. Each step is a
    grouped minimum and a join, whose skewed parts adaptive execution splits.
    Each step's edges are written to the checkpoint folder.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = cut(now), None
    apart = F.col("u").bitwiseXOR(F.lit(0))  # the same number, but dealt anew for the join, so that a hub's edges there can be split over tasks
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(apart.alias("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(apart.alias("u"), "m")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        last = state
