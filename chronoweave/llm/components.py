"""Connected components of a link table by alternating stars, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them; links point from large to small."""
    least = cut_lineage(links.groupBy("a").agg(F.min("b").alias("m")))
    return links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node with a link, from links (a, b) of two longs.

    Rounds grow with the logarithm of the longest path. A hub's smallest neighbour is found with partial aggregates and written,
    so that the join back to its links is one of two plain shuffles, which adaptive execution can split; nothing but one flag a
    round comes to the driver.
    """
    held = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        held = cut_lineage(_small_star(cut_lineage(_large_star(held))))
        doubled = held.groupBy("a").count().filter("count > 1").select("a")
        if doubled.unionByName(held.select("a").join(held.select(F.col("b").alias("a")), "a", "left_semi")).isEmpty():
            roots = held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
