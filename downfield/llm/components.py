"""Connected components by alternating large and small stars: joins and minimum aggregates of edges only.

No neighbourhood is ever collected; a node of a third of all edges is pre-aggregated in each task, and the join that gives its
minimum back to its edges is one that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from downfield.llm.shared import cut, discard, tidy

ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has an edge to another; null ends are left out."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now, before = cut(now, "edges"), None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: a node and its neighbours below go to the least of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, cut(small, "edges")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no stable components after {ROUNDS} rounds")
    tidy(edges.sparkSession)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
