"""Connected components by alternating large-star and small-star steps over an edge table.

Each step takes every node's least neighbour and re-links the others to it; the rounds
grow with the logarithm of the graph's size. Each round's edges are written to the
shared folder, so that lineage stays short and a lost executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); ``root`` is the component's least node."""
    n = edges.count()
    e = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", n)
    for _ in range(most_rounds):
        # done if each node points to one root, which points nowhere
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("b", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)")
        if open_.isEmpty():
            break
        n = e.count()
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup_join(both, least, "a", "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e1 = written(large.where("a != b"), "edges", n)
        n1 = e1.count()
        least = e1.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup_join(e1, least, "a", "n", n1)
        out = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = written(out.where("a != b").distinct(), "edges", n1)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
