"""Connected components of a table of links, by alternating large and small stars; every round is an aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equireach.llm.common import Scratch, join_counted


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("size"))


def components(links: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(id, component), one row for each id that a link (a, b) names; component is the smallest id reachable.

    The edges of a hub, a node with many, meet a broadcast of the hubs and are not brought to one task.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    turn, before, n = 0, None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("u", "low").alias("low"), "size")
        large = join_counted(both, low, ["u"], "size", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, f"{name}-large-{turn}")
        low = _lowest(large)
        joined = join_counted(large, low, ["u"], "size", 2 * n)
        small = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).distinct()
        turn += 1
        edges = scratch.table(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-large-{turn - 1}")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (state["n"], state["s"]):
            ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())
        before, n = (state["n"], state["s"]), state["n"]
