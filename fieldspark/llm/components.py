"""Connected components of a link table by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of the links the smallest node it is connected with.

    Distributed union-find: every node hangs on its smallest neighbour, paths are halved twice, links are drawn
    between the parents, and the rest is contracted again until no link is left.  Each round at least halves the
    nodes that still have links, so there are few rounds; lineage ends with each round's tables."""
    edges = written(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links"
    )
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("up")).union(edges.select("a", "b"))
        parent = both.groupBy("node").agg(F.least(F.min("up"), F.col("node")).alias("up"))
        for _ in range(2):
            parent = written(parent, "parents")
            above = parent.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
            parent = parent.join(above, F.col("up") == F.col("__n")).select("node", F.col("__u").alias("up"))
        parent = written(parent, "parents")
        to = lambda c: parent.select(F.col("node").alias(c), F.col("up").alias(f"__{c}"))
        edges = written(
            edges.join(to("a"), "a").join(to("b"), "b")
            .select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))
            .filter("a < b").distinct(),
            "links",
        )
        if found is None:
            found = parent.withColumnRenamed("up", "component")
        else:
            # Roots of this round that moved on, and nodes that hang on them.
            moved = parent.select(F.col("node").alias("__n"), "up")
            found = written(
                found.join(moved, F.col("component") == F.col("__n"), "left").select(
                    "node", F.coalesce("up", "component").alias("component")
                ),
                "components",
            )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
