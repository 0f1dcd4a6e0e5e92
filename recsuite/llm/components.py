"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Alternating large-star and small-star rounds: in a large-star round every node hands its smallest neighbour to its
    larger neighbours, in a small-star round to its smaller ones, until the links are stars around the smallest nodes.
    The rounds needed grow with the logarithm of the component size.  Both are a minimum per node (partial aggregation
    runs before the shuffle) and one join of the links with it, so a node with very many links is never gathered; the
    join's large keys are split by adaptive execution.  Each round is cut off by a checkpoint in shared storage."""
    edge = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edge = cut_lineage(edge)
    while True:
        # large star: every larger neighbour of a node, and the node, meet the smallest of all its neighbours
        both = edge.select("u", "v").union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours of a node, and the node, meet the smallest of them
        star = cut_lineage(star.filter("u <> v").distinct())
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        rest = star.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut_lineage(low.select("u", F.col("m").alias("v")).union(rest).distinct())
        done = new.count() == edge.count() and new.exceptAll(edge).isEmpty()
        edge = new
        if done:
            break
    roots = edge.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
