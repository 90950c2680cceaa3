"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of any ordered type -> (node, root): root is the least node of the component, also for itself.

    Loops and repeated pairs don't matter; an empty table gives an empty table. Each round moves every edge towards
    the least node it can see; the minima are aggregated before they are joined, so a node with very many neighbours
    is no single task's work. The table is written after each round; rounds go on until nothing changes.
    """
    e = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour of u, and u, points to the least of u and its neighbours.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        changed = new.join(e, ["a", "b"], "left_anti").limit(1).count()
        e = new
        if not changed:
            break
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
