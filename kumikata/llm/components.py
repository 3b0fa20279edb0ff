"""Connected components as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumikata.plans.runtime import cut, cut_and_measured, spread


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): `component` is the least node reachable over `edges` (a, b), whatever their direction.

    Alternates large-star and small-star steps on the edges alone, which halve the distances, until no edge changes; the number of rounds
    grows with the logarithm of the longest chain. Null ends, loops and repeated edges are left out; nodes without an edge are their own component.
    """
    flat = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    before = None
    while True:
        # large star: every larger neighbour is hung below the least node around
        both = flat.unionByName(flat.select(F.col("high").alias("low"), F.col("low").alias("high"))).select(F.col("low").alias("node"), F.col("high").alias("next"))
        least = both.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("least"))
        large = both.join(spread(least), "node").where("next > node").select(F.col("least").alias("low"), F.col("next").alias("high")).where("low <> high")
        # small star: every smaller neighbour too
        least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        hung = large.join(spread(least), F.col("high") == F.col("node"))
        small = hung.select(F.col("least").alias("low"), F.col("low").alias("high")).where("low <> high").unionByName(least.select(F.col("least").alias("low"), F.col("node").alias("high"))).distinct()
        flat, now = cut_and_measured(small, edges=F.count("*"), hashes=F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")))
        if now == before:
            break
        before = now
    return nodes.select("node").distinct().join(spread(flat.select(F.col("high").alias("node"), F.col("low").alias("component"))), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
