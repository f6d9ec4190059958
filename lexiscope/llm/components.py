"""Connected components of a graph of links, by alternating large-star and
small-star steps. Nodes are numbers; every node ends up at the smallest number
it can reach. Nothing is gathered: each step is an aggregation and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import discard, materialized


def _stars(links: DataFrame, smaller_only: bool) -> DataFrame:
    """Large star: link every larger neighbour of a node to the smallest node
    around it. Small star: link a node and its smaller neighbours to the
    smallest of them. Links are (u, v) with u > v."""
    if smaller_only:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        near = links.join(least, "u")
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (moved.unionByName(least.select("u", F.col("m").alias("v")))
                .where("u > v").distinct())
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link. ``links`` may repeat;
    links with a null end or from a node to itself are ignored."""
    edges = materialized(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
                         .distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        before, edges = edges, materialized(_stars(_stars(edges, False), True))
        discard(before)
