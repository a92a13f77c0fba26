"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idweft.llm.storage import discard, written

MOST_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; every edge keeps its component."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("least"))
    joined = large.join(least, "a")
    small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return small.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of its component for every node that has an edge.

    ``edges`` has columns ``a`` and ``b`` of one type that orders. Each round is written, so
    the plan stays short; the rounds grow with the logarithm of the longest chain. Only two
    numbers of each round come to the driver.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    seen = mark(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        before, now = now, written(_stars(now), "edges")
        discard(before)
        if (found := mark(now)) == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
