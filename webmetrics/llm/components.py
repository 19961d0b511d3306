"""Connected components of links, by alternating stars, one pair of shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (only larger ones, or only others) joined to the smallest of it and them.

    The smallest comes from a group-by, combined before the shuffle, so a node with very many links is no task
    of its own: its links are a skewed join, which Spark splits.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a")
    if large:
        joined = joined.withColumn("m", F.least("a", "m")).where(F.col("b") > F.col("a"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select("a", F.col("m").alias("b"))
    others = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(others).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b: long), `component` being the smallest node reachable.

    Loops and nulls are ignored, links may repeat and point either way. Each round is kept in the checkpoint
    folder; rounds grow with the logarithm of the longest chain. Only counts reach the driver.
    """
    pairs = links.where("a is not null and b is not null and a != b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        pairs = cut(_stars(cut(_stars(pairs, large=True)), large=False))
        new = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
