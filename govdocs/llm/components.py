"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import Scratch


def star(edges: DataFrame, large: bool, scratch: Scratch, turn: int) -> DataFrame:
    """Connects the neighbours of each node to the smallest of them: only the larger ones (large) or the smaller ones and the node."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        least = scratch.put(f"least-small{turn}", edges.groupBy("b").agg(F.min("a").alias("m")))
        joined = edges.join(least, "b")
        out = joined.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
        out = out.unionByName(least.select(F.col("m").alias("a"), "b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and comp (the smallest node of its component) for all nodes of edges (a < b, long).

    Steps repeat until neither changes the edges; then each component is a star around its smallest
    node. Every step is written to the shared folder. Without edges the result is empty.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.put("edges-0", edges.select("a", "b").distinct())
    before, turn = state(now), 0
    while before[0]:
        turn += 1
        large = scratch.put(f"large{turn}", star(now, True, scratch, turn))
        now = scratch.put(f"small{turn}", star(large, False, scratch, turn))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())
