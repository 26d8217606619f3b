"""Connected components of an undirected graph as joins and aggregations, for any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternating large-star and small-star steps: each links a node's neighbours to its smallest one.
    Ends in a number of rounds that grows with the logarithm of the size. Every round is written to the
    shared folder, so lineage stays short and executors may be lost; older rounds are dropped. Nodes are
    never gathered on the driver. Nulls are left out; loops and repeated edges change nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.save(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "now0")
    before, step = None, 0
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = scratch.save(large.distinct(), f"large{step}")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"now{step}")
        scratch.drop(f"large{step}", f"now{step - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
