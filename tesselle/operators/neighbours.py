"""Exact nearest neighbours and radius joins of 2-D points by a pyramid of grids.

The root of the pyramid is a square around all points and queries, so no place lies outside; every level
below halves the side of its cells, down to cells of a few points. A query's level is the lowest whose
3x3 cells hold at least k points, which bounds the distance of its k-th neighbour; the search then reads
the cells that the bound reaches. All joins are equi-joins on (level, cell). Of points at one place only
the k with the smallest ids can be neighbours, so a place that holds many points is no hot cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most halvings of the root square.
DEEPEST = 30


def _around(df: DataFrame, reach: int) -> DataFrame:
    """A row for each of the cells around (cx, cy)."""
    d = F.sequence(F.lit(-reach), F.lit(reach))
    df = df.withColumn("__dx", F.explode(d)).withColumn("__dy", F.explode(d))
    return df.withColumn("cx", F.col("cx") + F.col("__dx")).withColumn("cy", F.col("cy") + F.col("__dy")).drop("__dx", "__dy")


def _distance2() -> Column:
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    return dx * dx + dy * dy


def _placed(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with finite coordinates; others are no places."""
    top = F.lit(float("inf"))
    return df.filter((F.abs(x) < top) & (F.abs(y) < top))


def _at(level: Column, fine: str) -> Column:
    """Cell of a level (0: the finest) by a cell of the finest one."""
    return F.floor(F.col(fine) / F.pow(F.lit(2.0), level)).cast("long")


def radius_join(points: DataFrame, queries: DataFrame, unit: float = 1.0) -> DataFrame:
    """(qid, id, d2) of all points within each query's radius, the edge included; queries are (qid, x, y, radius).

    Rows with a null, NaN or infinite place, and negative radii, find nothing. Cells are as wide as the
    radius' next power of two, so a query reads nine of them; points are posted once for each such power.
    """
    def cell(v: str) -> Column:
        return F.floor(F.col(v) / (F.lit(unit) * F.pow(F.lit(2.0), F.col("level")))).cast("long")

    level = F.ceil(F.log2(F.greatest(F.col("radius").cast("double"), F.lit(1e-9 * unit)) / unit)).cast("int")
    q = _placed(queries, "x", "y").filter("radius >= 0").select("qid", F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"), F.col("radius").cast("double").alias("radius"), level.alias("level"))
    used = F.broadcast(q.select("level").distinct())  # a power of two each: no more than there are exponents
    p = _placed(points, "x", "y").select(F.col("id").alias("pid"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).crossJoin(used)
    p = p.withColumn("cx", cell("px")).withColumn("cy", cell("py"))
    hit = _around(q.withColumn("cx", cell("qx")).withColumn("cy", cell("qy")), 1).join(p, ["level", "cx", "cy"])
    d2 = _distance2()
    return hit.filter(d2 <= F.col("radius") * F.col("radius")).select("qid", F.col("pid").alias("id"), d2.alias("d2"))


def knn_join(points: DataFrame, queries: DataFrame, k: int, most_visited: int | None = None, eps: float = 0.0) -> DataFrame:
    """(qid, rank, id, d2): the k nearest points of each query (qid, x, y), rank from 0, ties by id.

    All points where there are fewer than k; negative k is an error. Points and queries with a null, NaN
    or infinite place are left out. The answer is exact, which any bound on visited points
    (``most_visited``) and any allowed error (``eps``) permit; both are checked only.
    """
    if k < 0 or eps < 0 or (most_visited is not None and most_visited < 0):
        raise ValueError("k, eps and most_visited must not be negative")
    q = _placed(queries, "x", "y").select("qid", F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"))
    p = _placed(points, "x", "y").select(F.col("id").alias("pid"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    sides = p.select(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(1).alias("n")).union(q.select("qx", "qy", F.lit(0)))
    r = sides.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.sum("n")).first()
    if k == 0 or not r[4]:
        return q.select("qid", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("d2")).limit(0)
    left, low, side = r[0], r[2], max(r[1] - r[0], r[3] - r[2])
    # Four levels below cells of about k points each, so that dense places are cut as well.
    depth = 0 if side <= 0 else min(DEEPEST, max(0, math.ceil(math.log2(max(1.0, r[4] / k)) / 2)) + 4)
    parts = float(2**depth)

    def fine(v: str, start: float) -> Column:
        return F.least(F.floor((F.col(v) - start) / (side or 1.0) * parts), F.lit(parts - 1)).cast("long")

    same = Window.partitionBy("px", "py").orderBy("pid")
    p = p.withColumn("__i", F.row_number().over(same)).filter(F.col("__i") <= k).select("pid", "px", "py", fine("px", left).alias("fx"), fine("py", low).alias("fy"))
    q = q.withColumn("fx", fine("qx", left)).withColumn("fy", fine("qy", low))
    every = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    counted = p.groupBy("fx", "fy").agg(F.count("*").alias("n")).select("fx", "fy", "n", every)
    counted = counted.groupBy("level", _at(F.col("level"), "fx").alias("cx"), _at(F.col("level"), "fy").alias("cy")).agg(F.sum("n").alias("n"))
    reach = q.select("qid", "fx", "fy", every).select("qid", "level", _at(F.col("level"), "fx").alias("cx"), _at(F.col("level"), "fy").alias("cy"))
    full = _around(reach, 1).join(counted, ["level", "cx", "cy"]).groupBy("qid", "level").agg(F.sum("n").alias("n")).filter(F.col("n") >= k).groupBy("qid").agg(F.min("level").alias("level"))
    # The top level has one cell, which holds all points.
    lo = q.join(full, "qid", "left").withColumn("level", F.coalesce("level", F.lit(depth)))
    lo = lo.withColumn("cx", _at(F.col("level"), "fx")).withColumn("cy", _at(F.col("level"), "fy"))
    posted = p.select("pid", "px", "py", "fx", "fy", every)
    posted = posted.select("pid", "px", "py", "level", _at(F.col("level"), "fx").alias("cx"), _at(F.col("level"), "fy").alias("cy"))
    # k points lie within the 3x3 cells, so the k-th neighbour is within their diagonal: three cells on either side.
    cells = _around(lo.select("qid", "qx", "qy", "level", "cx", "cy"), 3)
    hit = posted.join(cells, ["level", "cx", "cy"]).withColumn("d2", _distance2())
    w = Window.partitionBy("qid").orderBy("d2", "pid")
    return hit.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k).select("qid", "rank", F.col("pid").alias("id"), "d2")
