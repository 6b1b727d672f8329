"""Points, boxes and outlines as structs and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"])


def subtract(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def scale(a: Column, k: Column) -> Column:
    return point(a["x"] * k, a["y"] * k)


def divide(a: Column, k: Column, whole: bool = False) -> Column:
    """Coordinates by a number; ``whole`` cuts towards zero. Dividing by zero is an error."""
    x, y = a["x"] / k, a["y"] / k
    return point(x.cast("int"), y.cast("int")) if whole else point(x, y)


def dot(a: Column, b: Column) -> Column:
    """Scalar product; of whole numbers an overflow is an error."""
    return a["x"] * b["x"] + a["y"] * b["y"]


def norm2(a: Column) -> Column:
    return dot(a, a)


def length(a: Column) -> Column:
    x, y = a["x"].cast("double"), a["y"].cast("double")
    return F.sqrt(x * x + y * y)


def normalized(a: Column) -> Column:
    """Direction of a vector; of the zero vector an error."""
    n = length(a)
    ok = F.when(n > 0, n).otherwise(F.raise_error(F.lit("the zero vector has no direction")).cast("double"))
    return point(a["x"] / ok, a["y"] / ok)


def text(a: Column) -> Column:
    return F.concat(F.lit("("), a["x"].cast("string"), F.lit(", "), a["y"].cast("string"), F.lit(")"))


def bbox(x: Column, y: Column) -> Column:
    """Half-open box around pixels, as an aggregate; null without rows."""
    box = F.struct(F.min(x).cast("int").alias("min_x"), F.min(y).cast("int").alias("min_y"), (F.max(x) + 1).cast("int").alias("max_x"), (F.max(y) + 1).cast("int").alias("max_y"))
    return F.when(F.count(x) > 0, box)


def union_box(box: Column) -> Column:
    """Box around boxes, as an aggregate; null boxes are empty."""
    return F.when(F.count(box) > 0, F.struct(*[f(box[c]).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))]))


def box_width(box: Column) -> Column:
    return F.coalesce(box["max_x"] - box["min_x"], F.lit(0))


def box_height(box: Column) -> Column:
    return F.coalesce(box["max_y"] - box["min_y"], F.lit(0))


def box_contains(box: Column, x: Column, y: Column) -> Column:
    return F.coalesce((x >= box["min_x"]) & (x < box["max_x"]) & (y >= box["min_y"]) & (y < box["max_y"]), F.lit(False))


def centroid(x: Column, y: Column) -> Column:
    """Mean point, rounded half away from zero, as an aggregate; (0, 0) without rows."""
    return point(F.coalesce(F.round(F.avg(x)), F.lit(0.0)).cast("int"), F.coalesce(F.round(F.avg(y)), F.lit(0.0)).cast("int"))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; to its one point where the segment has no length."""
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
    l2 = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.when(l2 > 0, l2)
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def signed_area(df: DataFrame, by: list[str], seq: str, x: str = "x", y: str = "y") -> DataFrame:
    """``by`` and the signed area of each closed outline, its points in ``seq`` order; the last point joins the first."""
    w = Window.partitionBy(*by).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead(x).over(w), F.first(x).over(whole))
    ny = F.coalesce(F.lead(y).over(w), F.first(y).over(whole))
    rows = df.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"), nx.alias("__nx"), ny.alias("__ny"))
    cross = F.col("__x").cast("double") * F.col("__ny") - F.col("__nx").cast("double") * F.col("__y")
    return rows.groupBy(*by).agg((F.sum(cross) * 0.5).alias("area"))
