"""Raster operators on pixel tables.

A pixel table is dense: one row for each (image_id, y, x). Neighbourhoods are window frames over
image rows, then over image columns, so a task needs one row or column of an image at a time;
separable operators never touch a two-dimensional window.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.functions import stats

ROW, COLUMN = ("image_id", "y"), ("image_id", "x")


def _line(axis: str):
    return Window.partitionBy(*(ROW if axis == "x" else COLUMN)).orderBy(axis)


def _both(df: DataFrame, value: str, along) -> DataFrame:
    """Apply a one-axis operator to rows, then to columns."""
    return along(along(df, value, "x"), value, "y")


def dense(df: DataFrame) -> DataFrame:
    """A side with a row for each pixel: joined by sorting, never sent to all executors. Spark takes an exploded table
    to be as small as what it was made of, and would gather it on the driver."""
    return df.hint("merge")


# ---- sizes, edges, thresholds ----


def sizes(pixels: DataFrame) -> DataFrame:
    """image_id, width, height."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def with_size(pixels: DataFrame) -> DataFrame:
    """The pixels with their image's width and height; sizes are one row for each image, joined on image_id."""
    return pixels.join(sizes(pixels), "image_id")


def perimeter(pixels: DataFrame) -> DataFrame:
    """Pixels on the outer edge of their image, each once."""
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)
    return with_size(pixels).filter(edge).drop("width", "height")


def background_threshold(pixels: DataFrame, value: str = "v", factor: float = 1.5, p: float = 90) -> DataFrame:
    """image_id and the threshold: ``factor`` times a percentile of the perimeter, in 0..255."""
    t = stats.percentile(F.col(value).cast("double"), p) * factor
    return perimeter(pixels).groupBy("image_id").agg(F.least(F.greatest(t, F.lit(0.0)), F.lit(255.0)).alias("thr"))


def threshold_mask(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, y, x, fg): pixels above their image's background threshold."""
    return pixels.join(background_threshold(pixels, value), "image_id").select("image_id", "y", "x", (F.col(value) > F.col("thr")).alias("fg"))


# ---- morphology ----


def _dilate_axis(radius: int):
    def along(df: DataFrame, value: str, axis: str) -> DataFrame:
        return df.withColumn(value, F.max(value).over(_line(axis).rowsBetween(-radius, radius)))

    return along


def _erode_axis(radius: int):
    def along(df: DataFrame, value: str, axis: str) -> DataFrame:
        w = _line(axis).rowsBetween(-radius, radius)
        return df.withColumn(value, F.min(value).over(w) & (F.count(F.lit(1)).over(w) == 2 * radius + 1))

    return along


def dilate(mask: DataFrame, radius: int) -> DataFrame:
    """Any foreground within a square of ``radius``; the square is cut at the image's edge."""
    return mask if radius == 0 else _both(mask, "fg", _dilate_axis(radius))


def erode(mask: DataFrame, radius: int) -> DataFrame:
    """All foreground within a square of ``radius``; what lies outside the image is background."""
    return mask if radius == 0 else _both(mask, "fg", _erode_axis(radius))


def foreground_mask(pixels: DataFrame, value: str = "v", grow: int = 2, shrink: int = 2) -> DataFrame:
    """Threshold, dilate, erode."""
    return erode(dilate(threshold_mask(pixels, value), grow), shrink)


def _box_sum(df: DataFrame, value: str) -> DataFrame:
    return _both(df, value, lambda d, v, axis: d.withColumn(v, F.sum(v).over(_line(axis).rowsBetween(-1, 1))))


def border_pixels(mask: DataFrame, least: int = 2) -> DataFrame:
    """(image_id, y, x, border): foreground with at least ``least`` background pixels around; outside counts as background."""
    if not 0 <= least <= 8:
        raise ValueError("a pixel has eight neighbours")
    n = _box_sum(mask.withColumn("n", F.col("fg").cast("int")), "n")
    return n.select("image_id", "y", "x", (F.col("fg") & (9 - F.col("n") >= least)).alias("border"))


def fill_gaps(mask: DataFrame) -> DataFrame:
    """Background pixels between two opposite foreground neighbours (rows, columns, diagonals) become foreground.

    Only pixels with all eight neighbours are filled; the neighbours are those of the input.
    """
    row = _line("x")
    near = mask.select("image_id", "y", "x", "fg", F.lag("fg").over(row).alias("l"), F.lead("fg").over(row).alias("r"))
    col = _line("y")
    up, down = {c: F.lag(c).over(col) for c in ("l", "fg", "r")}, {c: F.lead(c).over(col) for c in ("l", "fg", "r")}
    near = near.select("image_id", "y", "x", "fg", "l", "r", *[c.alias(f"u{k}") for k, c in up.items()], *[c.alias(f"d{k}") for k, c in down.items()])
    inside = F.col("ul").isNotNull() & F.col("dr").isNotNull()
    pair = (F.col("l") & F.col("r")) | (F.col("ufg") & F.col("dfg")) | (F.col("ul") & F.col("dr")) | (F.col("ur") & F.col("dl"))
    return near.select("image_id", "y", "x", (F.col("fg") | (inside & pair)).alias("fg"))


# ---- filters ----


def gaussian_kernel(sigma: float, least_radius: int = 0) -> list[float]:
    """Normalised weights at -radius..radius with radius ceil(3 sigma); one weight where sigma is not positive."""
    if sigma <= 0:
        return [1.0]
    r = max(least_radius, math.ceil(3 * sigma))
    k = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def _shifted(value: str, axis: str, d: int) -> Column:
    """The value ``d`` places on along an axis; beyond the edge the last one."""
    w = _line(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if d == 0:
        return F.col(value)
    return F.coalesce(F.lag(value, -d).over(w), F.first(value).over(whole)) if d < 0 else F.coalesce(F.lead(value, d).over(w), F.last(value).over(whole))


def _weighted(value: str, axis: str, kernel: list[float]) -> Column:
    r = len(kernel) // 2
    return reduce(lambda a, b: a + b, [_shifted(value, axis, d) * F.lit(k) for d, k in zip(range(-r, r + 1), kernel)])


def gaussian_blur(pixels: DataFrame, sigma: float, value: str = "v") -> DataFrame:
    """Separable Gaussian, rows then columns; edges repeat."""
    k = gaussian_kernel(sigma)
    return _both(pixels.withColumn(value, F.col(value).cast("double")), value, lambda d, v, axis: d.withColumn(v, _weighted(v, axis, k)))


def sobel(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, y, x, dx, dy, mag, angle): 3x3 gradients, angle in [0, 360); zero on the edge and where flat."""
    row, col = _line("x"), _line("y")
    p = pixels.select("image_id", "y", "x", F.col(value).cast("double").alias("v"), F.lag(value).over(row).alias("l"), F.lead(value).over(row).alias("r"))
    p = p.select("image_id", "y", "x", (F.col("r") - F.col("l")).cast("double").alias("diff"), (F.col("l") + 2 * F.col("v") + F.col("r")).cast("double").alias("smooth"))
    p = p.select(
        "image_id",
        "y",
        "x",
        (F.lag("diff").over(col) + 2 * F.col("diff") + F.lead("diff").over(col)).alias("dx"),
        (F.lead("smooth").over(col) - F.lag("smooth").over(col)).alias("dy"),
    )
    inside = F.col("dx").isNotNull() & F.col("dy").isNotNull()
    p = p.select("image_id", "y", "x", *[F.when(inside, F.col(c)).otherwise(0.0).alias(c) for c in ("dx", "dy")])
    mag = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    turn = F.degrees(F.atan2("dy", "dx"))
    angle = F.when(mag <= 1e-6, 0.0).when(turn < 0, turn + 360.0).otherwise(turn)
    return p.select("image_id", "y", "x", "dx", "dy", mag.alias("mag"), angle.alias("angle"))


def non_maximum_suppression(gradients: DataFrame) -> DataFrame:
    """(image_id, y, x, edge): magnitudes not exceeded by either neighbour along the gradient, in four directions."""
    row, col = _line("x"), _line("y")
    g = gradients.select("image_id", "y", "x", "mag", "angle", F.lag("mag").over(row).alias("l"), F.lead("mag").over(row).alias("r"))
    g = g.select("*", *[f(c).over(col).alias(f"{n}{c}") for n, f in (("u", F.lag), ("d", F.lead)) for c in ("l", "mag", "r")])
    sector = F.floor(F.pmod(F.col("angle") + 22.5, F.lit(180.0)) / 45.0)
    pairs = [("l", "r"), ("ul", "dr"), ("umag", "dmag"), ("ur", "dl")]
    keep = reduce(lambda a, b: a | b, [(sector == k) & (F.col("mag") >= F.coalesce(F.col(a), F.lit(0.0))) & (F.col("mag") >= F.coalesce(F.col(b), F.lit(0.0))) for k, (a, b) in enumerate(pairs)])
    return g.select("image_id", "y", "x", ((F.col("mag") > 0) & keep).alias("edge"))


# ---- resampling ----


def _target(n: Column, s: float) -> Column:
    return F.greatest(F.lit(1), F.round(n * F.lit(s))).cast("int")


def _ratio(ratio: float) -> float:
    """Scale of a downscale ratio; ratios above 1 and their reciprocals mean the same."""
    if ratio <= 0:
        raise ValueError("the ratio must be positive")
    return 1.0 / ratio if ratio > 1 else ratio


def _grid(pixels: DataFrame, s: float) -> DataFrame:
    """Target pixels of every image: image_id, width, height, ty, tx."""
    g = sizes(pixels).withColumn("ty", F.explode(F.sequence(F.lit(0), _target(F.col("height"), s) - 1)))
    return g.withColumn("tx", F.explode(F.sequence(F.lit(0), _target(F.col("width"), s) - 1)))


def _clamp(v: Column, n: str) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.col(n) - 1).cast("int")


def _names(value: str | tuple[str, ...]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _rounded(names: list[str]) -> list[Column]:
    """Channels rounded half away from zero into 0..255; sums are cut to nine decimals first, so that their order does not decide."""
    return [F.least(F.greatest(F.round(F.round(n, 9)), F.lit(0.0)), F.lit(255.0)).cast("int").alias(n) for n in names]


def downscale_nearest(pixels: DataFrame, ratio: float, value: str | tuple[str, ...] = "v") -> DataFrame:
    """The pixel at floor((target + 0.5) / s), clamped to the image; one channel or several."""
    s = _ratio(ratio)
    if abs(s - 1) < 1e-7:
        return pixels
    g = _grid(pixels, s)
    g = g.select("image_id", "ty", "tx", _clamp(F.floor((F.col("ty") + 0.5) / s), "height").alias("y"), _clamp(F.floor((F.col("tx") + 0.5) / s), "width").alias("x"))
    return dense(g).join(dense(pixels), ["image_id", "y", "x"]).select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), *_names(value))


def downscale_bilinear(pixels: DataFrame, ratio: float, value: str | tuple[str, ...] = "v") -> DataFrame:
    """Four neighbours around (target + 0.5) / s - 0.5, clamped to the image; rounded half away from zero."""
    s = _ratio(ratio)
    if abs(s - 1) < 1e-7:
        return pixels
    g = _grid(pixels, s)
    fy, fx = (F.col("ty") + 0.5) / s - 0.5, (F.col("tx") + 0.5) / s - 0.5
    g = g.withColumn("y0", F.floor(fy)).withColumn("x0", F.floor(fx)).withColumn("wy", fy - F.col("y0")).withColumn("wx", fx - F.col("x0"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    g = g.withColumn("c", corner)
    w = F.when(F.col("c.a") == 1, F.col("wy")).otherwise(1 - F.col("wy")) * F.when(F.col("c.b") == 1, F.col("wx")).otherwise(1 - F.col("wx"))
    g = g.select("image_id", "ty", "tx", _clamp(F.col("y0") + F.col("c.a"), "height").alias("y"), _clamp(F.col("x0") + F.col("c.b"), "width").alias("x"), w.alias("w"))
    out = dense(g).join(dense(pixels), ["image_id", "y", "x"]).groupBy("image_id", "ty", "tx").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in _names(value)])
    return out.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), *_rounded(_names(value)))


def downscale_area(pixels: DataFrame, ratio: float, value: str | tuple[str, ...] = "v") -> DataFrame:
    """Box filter for ratios of 2 and more, bilinear below.

    A target pixel covers [i / s - 0.5, (i + 1) / s - 0.5] of its axis, cut at the image. Each source
    pixel goes, with its share, to the one or two targets of each axis that it overlaps: one grouped
    sum, no join with the pixels.
    """
    s = _ratio(ratio)
    inv = 1.0 / s
    if abs(s - 1) < 1e-7:
        return pixels
    if inv < 2.0:
        return downscale_bilinear(pixels, ratio, value)
    p = with_size(pixels)

    def bins(axis: str, n: str) -> Column:
        lo = F.floor((F.col(axis) + 0.5) / inv)
        hi = F.ceil((F.col(axis) + 1.5) / inv) - 1
        top = _target(F.col(n), s) - 1
        a, b = F.least(F.greatest(lo, F.lit(0)), top).cast("int"), F.least(F.greatest(hi, F.lit(0)), top).cast("int")
        return F.explode(F.sequence(a, b))

    def share(t: str, axis: str, n: str) -> Column:
        left = F.least(F.greatest(F.col(t) * inv - 0.5, F.lit(0.0)), F.col(n).cast("double"))
        right = F.least(F.greatest((F.col(t) + 1) * inv - 0.5, F.lit(0.0)), F.col(n).cast("double"))
        return F.least(right, F.col(axis) + 1.0) - F.greatest(left, F.col(axis).cast("double"))

    p = p.withColumn("ty", bins("y", "height")).withColumn("tx", bins("x", "width"))
    p = p.withColumn("oy", share("ty", "y", "height")).withColumn("ox", share("tx", "x", "width")).filter("oy > 0 and ox > 0")
    w = F.col("oy") * F.col("ox")
    out = p.groupBy("image_id", "ty", "tx").agg(*[(F.sum(w * F.col(n)) / F.sum(w)).alias(n) for n in _names(value)])
    return out.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), *_rounded(_names(value)))


# ---- layout ----


def constant(image_id: DataFrame, width: int, height: int, value: int, name: str = "v") -> DataFrame:
    """Dense images of one value for every row of ``image_id``."""
    g = image_id.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return g.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), F.lit(value).alias(name))


def beside(left: DataFrame, right: DataFrame, value: str = "v") -> DataFrame:
    """Images side by side by image_id; the lower one is filled with zeros below."""
    a, b = sizes(left), sizes(right).select("image_id", F.col("width").alias("w2"), F.col("height").alias("h2"))
    both = a.join(b, "image_id")
    grid = both.withColumn("y", F.explode(F.sequence(F.lit(0), F.greatest("height", "h2") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") + F.col("w2") - 1))).select("image_id", "y", "x")
    moved = right.join(a.select("image_id", "width"), "image_id").select("image_id", "y", (F.col("x") + F.col("width")).cast("int").alias("x"), value)
    return grid.join(left.select("image_id", "y", "x", value).union(moved), ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce(value, F.lit(0)).alias(value))


def gather(pixels: DataFrame, at: DataFrame) -> DataFrame:
    """The pixels at given places (image_id, y, x and any other columns); places outside give nulls."""
    return at.join(pixels, ["image_id", "y", "x"], "left")
