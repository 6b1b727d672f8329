"""Drawing as relational work: shapes become pixel rows, layers become a maximum over their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.functions import pixels as px
from tesselle.functions import rng


def line_pixels(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with (step, x, y): pixels of lines (x0, y0, x1, y1), both ends included.

    The integer error walk has a closed form: after k steps along the longer axis the other has moved
    floor((2 k d + n) / (2 n)), n and d the longer and shorter extent; so a line is one sequence.
    """
    dx, dy = F.abs(F.col("x1") - F.col("x0")).cast("long"), F.abs(F.col("y1") - F.col("y0")).cast("long")
    n = F.greatest(dx, dy)
    k = F.col("step")
    rows = lines.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), n)))

    def moved(d: Column) -> Column:
        return F.when(n > 0, F.floor((2 * k * d + n) / F.when(n > 0, 2 * n))).otherwise(0)

    sx, sy = F.when(F.col("x0") < F.col("x1"), 1).otherwise(-1), F.when(F.col("y0") < F.col("y1"), 1).otherwise(-1)
    return rows.select(*keep, F.col("step").cast("int").alias("step"), (F.col("x0") + sx * moved(dx)).cast("int").alias("x"), (F.col("y0") + sy * moved(dy)).cast("int").alias("y"))


def thicken(pixels: DataFrame, thickness: int, width: int | None = None, height: int | None = None) -> DataFrame:
    """Each pixel as a square of radius ``thickness`` - 1, cut at the image where its size is given."""
    r = max(0, thickness - 1)
    out = pixels
    if r:
        d = F.sequence(F.lit(-r), F.lit(r))
        out = pixels.withColumn("__dx", F.explode(d)).withColumn("__dy", F.explode(d)).withColumn("x", F.col("x") + F.col("__dx")).withColumn("y", F.col("y") + F.col("__dy")).drop("__dx", "__dy")
    if width is not None and height is not None:
        out = out.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))
    return out


def circle_pixels(circles: DataFrame, keep: list[str], radius: str = "r", thickness: str = "t") -> DataFrame:
    """``keep`` with (x, y): rings of circles (cx, cy, r, t), radii r - t to r + t, both included."""
    outer, inner = (F.col(radius) + F.col(thickness)).cast("int"), F.greatest(F.lit(0), F.col(radius) - F.col(thickness)).cast("int")
    c = circles.withColumn("__dx", F.explode(F.sequence(-outer, outer))).withColumn("__dy", F.explode(F.sequence(-outer, outer)))
    d2 = F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy")
    return c.filter((d2 <= outer * outer) & (d2 >= inner * inner)).select(*keep, (F.col("cx") + F.col("__dx")).alias("x"), (F.col("cy") + F.col("__dy")).alias("y"))


def rectangle_pixels(rects: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with (x, y): outlines of rectangles (x0, y0, x1, y1), ends included, each pixel once."""
    r = rects.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return r.filter("x = x0 or x = x1 or y = y0 or y = y1").select(*keep, "x", "y")


def overlay(base: DataFrame, layers: DataFrame, value: list[str]) -> DataFrame:
    """The base with layers (image_id, y, x, z, values) on it; the highest z wins, places outside the base are cut.

    One grouped maximum over the union, so many layers cost one shuffle.
    """
    v = F.struct(*[F.col(c) for c in value])
    all_ = base.select("image_id", "y", "x", F.lit(-1).cast("long").alias("z"), v.alias("v")).union(layers.select("image_id", "y", "x", F.col("z").cast("long"), v.alias("v")))
    top = all_.groupBy("image_id", "y", "x").agg(F.max(F.struct("z", "v")).alias("top"), F.min("z").alias("low")).filter("low = -1")
    return top.select("image_id", "y", "x", *[F.col(f"top.v.{c}").alias(c) for c in value])


def colours(df: DataFrame, number: str, seed: int) -> DataFrame:
    """``df`` with r, g, b: three consecutive draws of one stream for each number from 0, low bytes."""
    state = rng.mix_seed(F.lit(seed if seed else rng.DEFAULT_SEED))
    three = rng.draws(rng.skip(state, F.col(number).cast("long") * 3, 24), 3)
    out = df.withColumn("__c", three)
    return out.select(*df.columns, *[F.element_at("__c", i).bitwiseAND(F.lit(255)).cast("int").alias(n) for i, n in ((1, "r"), (2, "g"), (3, "b"))])


def byte_colours(df: DataFrame, number: str, seed: int | Column = rng.DEFAULT_SEED) -> DataFrame:
    """``df`` with r, g, b: the three low bytes of the draw that each number from 0 has in the seed's stream; seed 0 is the default."""
    seed = F.lit(seed if seed else rng.DEFAULT_SEED) if isinstance(seed, int) else seed
    one = F.element_at(rng.draws(rng.skip(rng.mix_seed(seed), F.col(number).cast("long"), 24), 1), 1)
    out = df.withColumn("__c", one)
    return out.select(*df.columns, *[F.shiftright("__c", 8 * i).bitwiseAND(F.lit(255)).cast("int").alias(n) for i, n in enumerate("rgb")])


def signed_view(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Signed values on 0..255 by each image's largest magnitude, zero in the middle."""
    top = pixels.groupBy("image_id").agg(F.max(F.abs(value)).alias("__top"))
    return pixels.join(top, "image_id").select("image_id", "y", "x", px.signed_u8(F.col(value).cast("double"), F.col("__top")).alias(value))


def angle_view(gradients: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b): direction as hue, magnitude by the image's largest one as brightness."""
    top = gradients.groupBy("image_id").agg(F.max("mag").alias("__top"))
    light = F.least(F.greatest(F.col("mag") / F.when(F.col("__top") < 1e-6, 1.0).otherwise(F.col("__top")), F.lit(0.0)), F.lit(1.0))
    rgb = px.hue_rgb(px.wrap_degrees(F.col("angle")), light)
    return gradients.join(top, "image_id").select("image_id", "y", "x", *[c.alias(n) for n, c in zip("rgb", rgb)])


def arrow_lines(gradients: DataFrame, least: float, stride: int, length: float) -> DataFrame:
    """(image_id, x0, y0, x1, y1): a line along the gradient at every ``stride``-th place where its magnitude exceeds ``least``."""
    step = max(1, stride)
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    at = gradients.filter((F.col("y") % step == 0) & (F.col("x") % step == 0) & (F.col("mag") > least) & (size >= 1e-6))
    return at.select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.round(F.col("x") + length * F.col("dx") / size).cast("int").alias("x1"), F.round(F.col("y") + length * F.col("dy") / size).cast("int").alias("y1"))


def frame_pixels(rects: DataFrame, keep: list[str], thickness: int) -> DataFrame:
    """``keep`` with (x, y): ``thickness`` nested outlines of rectangles, each one pixel further out."""
    nested = rects.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(max(1, thickness) - 1))))
    nested = nested.select(*keep, *[(F.col(c) + F.col("__t") * sign).alias(c) for c, sign in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
    return rectangle_pixels(nested, keep)


def segment_layers(segments: DataFrame, seed: int, thickness: int = 1, radius: int = 3, ring: int = 1) -> DataFrame:
    """(image_id, y, x, z, r, g, b): each numbered segment (image_id, k, x0, y0, x1, y1) as a line with a ring at its start, in a colour of its own."""
    s = byte_colours(segments.select("image_id", "k", "x0", "y0", "x1", "y1"), "k", seed)
    lines = thicken(line_pixels(s, ["image_id", "k", "r", "g", "b"]), thickness)
    rings = circle_pixels(s.select("image_id", "k", "r", "g", "b", F.col("x0").alias("cx"), F.col("y0").alias("cy"), F.lit(radius).alias("__r"), F.lit(ring).alias("__t")), ["image_id", "k", "r", "g", "b"], "__r", "__t")
    z = F.col("k") * 2
    return lines.select("image_id", "y", "x", z.alias("z"), "r", "g", "b").union(rings.select("image_id", "y", "x", (z + 1).alias("z"), "r", "g", "b"))


def red_links(segments: DataFrame, links: DataFrame, thickness: int = 1) -> DataFrame:
    """(image_id, y, x, r, g, b): red lines from the end of segment ``k`` to the start of ``to_start``, and from its start to
    the end of ``to_end``, by (image_id, k, to_start, to_end); null or negative numbers link to nothing."""
    s = segments.select("image_id", "k", "x0", "y0", "x1", "y1")

    def lines(other: str, mine: tuple[str, str], theirs: tuple[str, str]) -> DataFrame:
        to = s.select("image_id", F.col("k").alias(other), F.col(theirs[0]).alias("__x"), F.col(theirs[1]).alias("__y"))
        got = links.select("image_id", "k", other).join(s, ["image_id", "k"]).join(to, ["image_id", other])
        return got.select("image_id", F.col(mine[0]).alias("x0"), F.col(mine[1]).alias("y0"), F.col("__x").alias("x1"), F.col("__y").alias("y1"))

    every = lines("to_start", ("x1", "y1"), ("x0", "y0")).union(lines("to_end", ("x0", "y0"), ("x1", "y1")))
    px_ = thicken(line_pixels(every, ["image_id"]), thickness).select("image_id", "y", "x").distinct()
    return px_.select("image_id", "y", "x", F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))


def mask_points(points: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, y, x): the distinct points of a mask that lie in an image of that size."""
    return points.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height)).select("image_id", "y", "x").distinct()


def label_colours(labels: DataFrame, seed: int = 0, void: int | None = None, label: str = "comp") -> DataFrame:
    """(image_id, y, x, r, g, b): a random colour for each label, numbered by its first pixel in reading order; ``void`` is black."""
    kept = labels if void is None else labels.filter(F.col(label) != void)
    first = kept.groupBy("image_id", label).agg(F.min(F.struct("y", "x")).alias("first"))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("first")) - 1
    palette = colours(first.select("image_id", label, number.alias("k")), "k", seed).drop("k")
    got = labels.join(palette, ["image_id", label], "left")
    return got.select("image_id", "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("r", "g", "b")])


def scale_by_max(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Values as 0..255 of the image's largest finite value; non-finite and everything where it is not positive: 0."""
    d = F.col(value).cast("double")
    ok = ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    top = pixels.groupBy("image_id").agg(F.max(F.when(ok, d)).alias("top"))
    v = F.when(ok & (F.col("top") > 0), F.least(F.greatest(d * 255.0 / F.when(F.col("top") > 0, F.col("top")), F.lit(0.0)), F.lit(255.0))).otherwise(0.0)
    return pixels.join(top, "image_id").select("image_id", "y", "x", F.round(v).cast("int").alias(value))


def scale_min_max(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Values as 0..255 between the image's least and largest finite ones; non-finite count as the least."""
    d = F.col(value).cast("double")
    ok = ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    ends = pixels.groupBy("image_id").agg(F.min(F.when(ok, d)).alias("lo"), F.max(F.when(ok, d)).alias("hi"))
    span = F.col("hi") - F.col("lo")
    v = F.when(ok & (span > 0), (d - F.col("lo")) * 255.0 / F.when(span > 0, span)).otherwise(0.0)
    return pixels.join(ends, "image_id").select("image_id", "y", "x", F.round(v).cast("int").alias(value))
