"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import materialise, salt_of, with_group_facts


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least one of the node and its neighbours.

    A node may have any number of neighbours: they are dealt to cells.
    """
    near = _both_ways(edges)
    known = with_group_facts(near, ["u"], salt_of(F.col("v")), {"m": F.min("v")}, {"m": F.min("m")})
    return known.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of links (u, v); a component is named by its least node.

    Alternating large and small stars end with every node linked to the least of its component, after about as many
    rounds as the logarithm of the longest path. Each round is written, so a lost executor costs one round.
    """
    edges = materialise(links.select("u", "v").filter("u != v").distinct(), "edges")
    mark = None
    while True:
        after = materialise(_small_star(_large_star(edges)).distinct(), "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        edges, mark = after, tuple(seen)
