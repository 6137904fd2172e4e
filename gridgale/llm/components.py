"""Connected components by alternating large and small stars, as joins and grouped minima.

The links of a round are written to the shared folder, so a round's lineage is one file scan. A hub
meets its minimum through a join (which adaptive execution splits), never through a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgale.llm.common import staged


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and that has none: then nothing is left to do."""
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(0).alias("is_root")).union(
        links.select("v", F.lit(None).cast("long"), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.max("is_root").alias("is_root"))
    return seen.where("a != b OR (is_root = 1 AND a IS NOT NULL)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another; ``root`` is the smallest node reachable.

    ``links`` holds pairs of integers (u, v); order, repeats, self-links and nulls do not matter.
    """
    pairs = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v")
    now = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        now = staged(_small_star(_large_star(now)), "links")
        if _are_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``roots`` and ``links`` together: only what the new links join
    is worked on."""
    names = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    ends = links.join(names, F.col("u") == F.col("_n"), "left").select(F.coalesce("_r", "u").alias("u"), "v")
    ends = ends.join(names, F.col("v") == F.col("_n"), "left").select("u", F.coalesce("_r", "v").alias("v"))
    joined = components(ends)
    moved = roots.join(joined.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("root") == F.col("_n"), "left")
    return moved.select("node", F.coalesce("_r", "root").alias("root")).union(
        joined.join(roots.select("node"), "node", "left_anti")
    )
