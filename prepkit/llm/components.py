"""Connected components by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm.scratch import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node that has an
    edge to another. NULL ends and loops are left out.

    Alternates two star contractions until there are stars alone: every node hangs its larger
    neighbours on its smallest neighbour, then its smaller ones and itself. Each round is
    grouped minima and a join, so a hub is combined before the shuffle and split by adaptive
    execution; the number of rounds grows with the logarithm of the longest path.
    """
    tree = stored(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
                  .where("node > root").distinct(), "edges")
    while not _stars_alone(tree):
        tree = stored(_small_star(_large_star(tree)), "stars")
    roots = tree.select(F.col("root").alias("node"), "root").distinct()
    return tree.unionByName(roots)


def _stars_alone(tree: DataFrame) -> bool:
    """Whether every node has one root, and no root hangs on another."""
    ends = tree.select("node", F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        tree.select("root", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return each.where("hangs > 1 or hangs = 1 and holds = 1").agg(F.count("*")).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("node", F.col("root").alias("other")).union(edges.select("root", "node"))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("low"))
    return (both.where("other > node").join(least, "node")
            .select(F.col("other").alias("node"), F.col("low").alias("root")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("node").agg(F.min("root").alias("low"))
    hung = edges.join(least, "node").where("root > low").select(F.col("root").alias("node"), F.col("low").alias("root"))
    return hung.union(least.select("node", "low")).distinct()
