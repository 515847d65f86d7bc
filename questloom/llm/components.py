"""Connected components of a table of links, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import stage_numbers


def _largest_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """Of links (a, b): (id, root) for every id that has a link to another; ``root`` is the smallest id it reaches.

    Each round hangs, for every id, its larger neighbours (first step) and then its smaller ones (second step) under
    its smallest neighbour, until all links lead to a root.  The number of rounds grows with the logarithm of the longest
    chain; links never become more.  Minima are combined before the exchange, and the joins of a crowded id may be
    split.  Rounds are written to the shared folder, so that no lineage builds up.
    """
    found = stage_numbers(_largest_first(edges.select("a", "b")).distinct(), "links")
    before = None
    while True:
        found = stage_numbers(_smaller_up(_larger_up(found)), "links")
        mark = found.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    roots = found.groupBy("b").agg(F.lit(1).alias("one")).select(F.col("b").alias("id"), F.col("b").alias("root"))
    return found.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


def _larger_up(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # As many rows as links: each is met once from its smaller end.
    return _largest_first(hung)


def _smaller_up(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _largest_first(hung.unionByName(least.select("a", F.col("m").alias("b")))).distinct()
