"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from calibrant.llm.common import discard, stored

# Parts into which the edges of a node are dealt, so that a hub with very many stands in no task alone.
SALTS = 32


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbors (larger ones only, or the others) linked to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    salts = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salts, ["a", "salt"])
    if larger:
        return linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.select("b", "m").union(least.select("a", "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """`node` and `root`, the least node of its component, for every node that is not a root.

    Edges are rows (a, b). Each round is written to the shared folder; rounds stop when the
    edges are stars around roots, which takes about as many as the logarithm of the longest path.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current, before = stored(ordered.distinct(), name), None
    while True:
        sums = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = sums
        large = _stars(current, larger=True).distinct()
        small = _stars(large, larger=False).where(F.col("a") != F.col("b")).distinct()
        last, current = current, stored(small, name)
        discard(last)
