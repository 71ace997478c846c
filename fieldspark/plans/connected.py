"""Connected parts of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.plans.sizing import cut_lineage


def _hung(links: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours on one side hung on the smallest of its neighbours and itself; a < b in all links."""
    if larger:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    else:
        near = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = near.filter("v > u") if larger else near.union(near.select("u", F.col("u").alias("v")).distinct())
    drawn = hung.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return drawn.filter("a < b").distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, part): for each node of the links the smallest node it is connected with.

    Nodes may be of any type that can be ordered.  Each round hangs every node's larger neighbours on its smallest one,
    then its smaller neighbours and itself on the smallest of these, until the links are stars; rounds grow with the
    square of the logarithm of the longest path at most.  Links without a partner or with itself are ignored."""
    edges = cut_lineage(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct())
    shape = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 2**31)).first()
    before = shape(edges)
    while True:
        edges = cut_lineage(_hung(_hung(edges, True), False))
        after = shape(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("part")).union(edges.select("a", "a").distinct())
