"""Steps of a distributed search for connected components: alternating large-star and small-star.

Every step is a grouped minimum and a join over edges (a, b); the caller stores a round's edges and
goes on until ``mark`` stays the same. The number of rounds grows with the logarithm of the longest
chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    moved = both.filter(F.col("b") > F.col("a")).join(least, "a")
    return moved.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; edges point from larger to smaller."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def mark(e: DataFrame) -> tuple[int, int]:
    """Number and hash of the edges, which are distinct; the hash can't overflow, however many there are."""
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("s")).first()
    return r.n, r.s or 0
