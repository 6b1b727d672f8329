"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; a step's edges are written to shared storage, so lineage
stays short and nothing but two counters reaches the driver. The number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.storage import discard, held_by, materialize
from tesselle.operators.stars import large_star, mark, small_star


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node that can be reached.

    ``edges`` has two long columns ``a`` and ``b``; rows with a null or with equal ends count for nothing.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = mark(now)
    while last[0]:
        nxt = materialize(small_star(large_star(now)), "edges")
        discard(now)
        now, was, last = nxt, last, mark(nxt)
        if last == was:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return held_by(out, now)
