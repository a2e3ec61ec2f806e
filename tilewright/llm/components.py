"""Connected components of a table of links by alternating large-star and small-star steps.

Each step is a grouped minimum with a combine before the shuffle, written down, and a join with it. Both sides of the join
are read from the shared folder, so that a hot node's rows can be split over many tasks. The links of a round are written, too, and
those of the round before removed. Nothing is collected but whether links are stars yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import drop, keep


def _large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours go to the least of its neighbours and itself; and the table of these."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
    return e.join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b"), low


def _small(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows come with a < b: each node's smaller neighbours and itself go to the least of them."""
    low = keep(e.groupBy("b").agg(F.min("a").alias("m")), "low")
    hang = e.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hang.unionByName(low.select(F.col("m").alias("a"), "b")).where("a <> b").distinct(), low


def _are_stars(e: DataFrame) -> bool:
    """Whether every b has one a, and no a is a b."""
    nodes = e.select(F.col("a").alias("node"), F.lit(1).alias("root"), F.lit(0).alias("n")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("root"), F.lit(1).alias("n")))
    return nodes.groupBy("node").agg(F.max("root").alias("root"), F.sum("n").alias("n")).where("n > 1 or (root = 1 and n > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), no nulls -> (node, root) for every node but roots: root is the least node reachable."""
    e = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = keep(e, "links")
    while not _are_stars(e):
        large, low = _large(e)
        large = keep(large.distinct(), "links")
        small, least = _small(large)
        small = keep(small, "links")
        drop(e, low, large, least)
        e = small
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
