"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, root): the smallest node of the component, for all nodes but the roots.

    Each pass turns edges towards the smallest neighbour; it ends when every edge points at a root. Only edges are
    shuffled, and a hub's edges are joined with its minimum, so none is gathered in one place.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        edges = cut_lineage(turned.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.filter("out + into > 1 and out > 0").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
