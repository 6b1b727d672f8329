"""What a run shows: overlays, swatches, pictures of matches, the folder of a run's pictures, and counts, all as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tesselle.functions import pixels as px
from tesselle.functions import rng, stats
from tesselle.operators import drawing, matching, objects, raster
from tesselle.plans import solve
from tesselle.sources import images

RGB = ["r", "g", "b"]
SEED = 123
#: Shade of an object in a picture of its mask, and of the ground of one that shows its corners.
DIM, GROUND = 120, 90


def darkened(colours: DataFrame, by: int = 2) -> DataFrame:
    return colours.select("image_id", "y", "x", *[px.darken(F.col(c), by).alias(c) for c in RGB])


def objects_overlay(colours: DataFrame, mask: DataFrame, seed: int = SEED) -> DataFrame:
    """Every object in a random colour, by its number, on the darkened image."""
    runs = objects.labelled(mask)
    shades = drawing.byte_colours(runs.select("image_id", "obj_id").distinct(), "obj_id", seed)
    layer = runs.select("image_id", "obj_id", "y", F.explode(F.sequence("x0", "x1")).alias("x")).join(shades, ["image_id", "obj_id"]).select("image_id", "y", "x", F.lit(0).alias("z"), *RGB)
    return drawing.overlay(darkened(colours), layer, RGB)


def _pixels_of(sides: DataFrame, *keep: str) -> DataFrame:
    return sides.select(*keep, F.explode(F.arrays_zip("xs", "ys")).alias("p")).select(*keep, F.col("p.ys").alias("y"), F.col("p.xs").alias("x"))


def sides_overlay(colours: DataFrame, sides: DataFrame, boxes: DataFrame, seed: int = SEED) -> DataFrame:
    """The sides' pixels in random colours on the darkened image; sides are in their boxes' coordinates."""
    at = sides.join(boxes.select("image_id", "obj_id", "min_x", "min_y"), ["image_id", "obj_id"])
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("obj_id", "side_id")) - 1
    tinted = drawing.byte_colours(at.select("image_id", "min_x", "min_y", "xs", "ys", number.alias("k")), "k", seed)
    layer = _pixels_of(tinted, "image_id", "min_x", "min_y", "k", *RGB)
    layer = layer.select("image_id", (F.col("y") + F.col("min_y")).alias("y"), (F.col("x") + F.col("min_x")).alias("x"), F.col("k").alias("z"), *RGB)
    return drawing.overlay(darkened(colours), layer, RGB)


def _on(base: DataFrame, layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Pictures (keys, y, x, r, g, b) with layers that bring a ``z``; the highest wins, what lies outside the base is cut."""
    v = F.struct(*RGB).alias("v")
    every = reduce(DataFrame.union, [x.select(*keys, "y", "x", F.col("z").cast("long").alias("z"), v) for x in [base.withColumn("z", F.lit(-1)), *layers]])
    top = every.groupBy(*keys, "y", "x").agg(F.max(F.struct("z", "v")).alias("t"), F.min("z").alias("low")).filter("low = -1")
    return top.select(*keys, "y", "x", *[F.col(f"t.v.{c}").alias(c) for c in RGB])


def framed(own: DataFrame, mask_shade: int | None = None) -> DataFrame:
    """(image_id, obj_id, y, x, r, g, b): each object's box; its own colours, or one shade, on black."""
    last = own.groupBy("image_id", "obj_id").agg(F.first("height").alias("h"), F.first("width").alias("w"))
    ground = last.select("image_id", "obj_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "w").select("image_id", "obj_id", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    shade = [F.col(c) if mask_shade is None else F.lit(mask_shade).alias(c) for c in RGB]
    return _on(ground.select("*", *[F.lit(0).alias(c) for c in RGB]), [own.select("image_id", "obj_id", "y", "x", F.lit(0).alias("z"), *shade)], ["image_id", "obj_id"])


def sides_on_mask(own: DataFrame, sides: DataFrame, seed: int = SEED) -> DataFrame:
    """(image_id, obj_id, y, x, r, g, b): the sides in random colours, a stream for each object, on its dimmed mask."""
    shades = drawing.byte_colours(sides.select("image_id", "obj_id", "side_id", "xs", "ys"), "side_id", F.col("obj_id").cast("long").bitwiseXOR(F.lit(seed).cast("long")))
    return _on(framed(own, DIM // 2), [_pixels_of(shades, "image_id", "obj_id", "side_id", *RGB).withColumnRenamed("side_id", "z")], ["image_id", "obj_id"])


def corners_on_mask(own: DataFrame, sides: DataFrame, seed: int = SEED) -> DataFrame:
    """(image_id, obj_id, y, x, r, g, b): the sides in the colours of a bare stream and red 5 x 5 corners, each side's first pixel, on the gray mask."""
    state = F.aggregate(F.sequence(F.lit(0), F.col("side_id")), F.lit(seed).cast("long"), lambda s, _: rng.step(s))
    shades = sides.withColumn("__c", state).select("image_id", "obj_id", "side_id", "xs", "ys", *[F.shiftright("__c", 8 * i).bitwiseAND(F.lit(255)).cast("int").alias(c) for i, c in enumerate(RGB)])
    layer = _pixels_of(shades, "image_id", "obj_id", "side_id", *RGB).withColumnRenamed("side_id", "z")
    first = sides.select("image_id", "obj_id", F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y"))
    disks = drawing.thicken(first, 3).select("image_id", "obj_id", "y", "x", F.lit(1 << 30).alias("z"), F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return _on(framed(own, GROUND), [layer, disks], ["image_id", "obj_id"])


def swatches(sides: DataFrame) -> DataFrame:
    """Each object's colours as an image: a row for each side, a column for each sample."""
    p = sides.select("image_id", "obj_id", F.col("side_id").alias("y"), F.posexplode(F.arrays_zip(*RGB)).alias("x", "c"))
    return p.select("image_id", "obj_id", "y", "x", *[F.col(f"c.{c}").alias(c) for c in RGB])


def match_lines(colours: DataFrame, lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Red lines between the centres of best matches on the image; line ends are in the boxes' coordinates of objects a and c."""
    a = boxes.select("image_id", F.col("obj_id").alias("a"), F.col("min_x").alias("ax"), F.col("min_y").alias("ay"))
    c = boxes.select("image_id", F.col("obj_id").alias("c"), F.col("min_x").alias("bx"), F.col("min_y").alias("by"))
    ends = lines.join(a, ["image_id", "a"]).join(c, ["image_id", "c"])
    ends = ends.select("image_id", (F.col("x0") + F.col("ax")).alias("x0"), (F.col("y0") + F.col("ay")).alias("y0"), (F.col("x1") + F.col("bx")).alias("x1"), (F.col("y1") + F.col("by")).alias("y1"))
    red = drawing.line_pixels(ends, ["image_id"]).select("image_id", "y", "x", F.lit(0).alias("z"), F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return drawing.overlay(colours.select("image_id", "y", "x", *RGB), red, RGB)


def match_pictures(own: DataFrame, sides: DataFrame, matches: DataFrame, seed: int = SEED) -> DataFrame:
    """(image_id, a, b, rank, c, d, dist, y, x, r, g, b): the two objects of every match side by side, dark, with the matched sides in colour."""
    keys = ["image_id", "a", "b", "rank", "c", "d", "dist"]
    box = framed(own).select("image_id", "obj_id", "y", "x", *[px.darken(F.col(c), 4).alias(c) for c in RGB])
    size = own.groupBy("image_id", "obj_id").agg(F.first("width").alias("w"))
    hue = (F.col("obj_id").cast("long") * 131 + F.col("side_id").cast("long") * 17).bitwiseXOR(F.lit(seed).cast("long"))
    lit = drawing.byte_colours(sides.select("image_id", "obj_id", "side_id", "xs", "ys", F.lit(0).alias("k")), "k", hue)
    lit = _pixels_of(lit, "image_id", "obj_id", "side_id", *RGB).withColumn("z", F.lit(0))
    shift = matches.join(size.select("image_id", F.col("obj_id").alias("a"), "w"), ["image_id", "a"])

    def part(o: str, s: str, moved: Column) -> tuple[DataFrame, DataFrame]:
        back = shift.join(box.withColumnRenamed("obj_id", "__o").select(F.col("image_id").alias("__i"), "__o", "y", "x", *[F.col(c).alias(f"__{c}") for c in RGB]), (F.col("image_id") == F.col("__i")) & (F.col(o) == F.col("__o")))
        front = shift.join(lit.select(F.col("image_id").alias("__i"), F.col("obj_id").alias("__o"), F.col("side_id").alias("__s"), "y", "x", "z", *[F.col(c).alias(f"__{c}") for c in RGB]), (F.col("image_id") == F.col("__i")) & (F.col(o) == F.col("__o")) & (F.col(s) == F.col("__s")))
        names = [F.col(k).alias(f"m_{k}") for k in keys]
        return back.select(*names, "y", (F.col("x") + moved).alias("x"), *[F.col(f"__{c}").alias(c) for c in RGB]), front.select(*names, "y", (F.col("x") + moved).alias("x"), "z", *[F.col(f"__{c}").alias(c) for c in RGB])

    (left, over_left), (right, over_right) = part("a", "b", F.lit(0)), part("c", "d", F.col("w"))
    return _on(left.union(right), [over_left, over_right], [f"m_{k}" for k in keys])


def match_file(base: str = "objects_side_matches", prefix: str = "") -> Column:
    """Path of a match's picture, from the columns a, b, rank, c, d, dist."""
    a, b, rank, c, d, dist = (F.col(f"{prefix}{n}") for n in ("a", "b", "rank", "c", "d", "dist"))
    name = F.concat(px.pixel_name(a), F.lit("-"), b, F.lit("_neighb"), rank, F.lit("_"), px.pixel_name(c), F.lit("-"), d, F.lit("_"), stats.fixed(dist, 2), F.lit(".png"))
    return F.concat(F.lit(f"{base}/"), px.pixel_name(a), F.lit("/side"), b, F.lit("/"), name)


def pictures(pixels: DataFrame, p: solve.Params = solve.Params(), debug: bool = True) -> DataFrame:
    """(name, data): every picture of a run as a PNG file, in a folder for each image.

    00_input_downscaled, 01_blur_gray, 02_foreground_mask, 03_objects_overlay and 04_best_side_matches;
    objects/NNNNimage and NNNNmask; objects_side_matches/NNNN with the object, its sides and a picture
    for each match; with ``debug`` the steps under debug-low.
    """
    small, mask = solve.segment(pixels, p)
    gray = small.select("image_id", "y", "x", px.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    soft = raster.gaussian_blur(gray, p.blur).withColumn("v", px.to_u8(F.col("v")))
    own = objects.own_pixels(small, mask, RGB, p.eight_connected)
    sides = solve.describe(pixels, p)
    matches = solve.solve(pixels, p)
    boxes = objects.objects(mask, p.eight_connected)
    centres = sides.select("image_id", "obj_id", "side_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    lines = matches.filter("rank = 0").select("image_id", "a", "b", "c").join(matching.best_lines(matches, centres), ["image_id", "a", "b"])

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.concat(F.col("image_id"), F.lit(f"/{name}")).alias("name"), "y", "x", *RGB)

    def each(df: DataFrame, name: Column) -> DataFrame:
        return df.select(F.concat(F.col("image_id"), F.lit("/"), name).alias("name"), "y", "x", *RGB)

    def level(df: DataFrame, v: Column) -> DataFrame:
        return df.select("image_id", "y", "x", *[v.alias(c) for c in RGB])

    white = level(mask, F.when(F.col("fg"), 255).otherwise(0))
    overlay = objects_overlay(small, mask)
    number, folder = px.pixel_name(F.col("obj_id")), F.concat(F.lit("objects_side_matches/"), px.pixel_name(F.col("obj_id")))
    shown, masks = framed(own), framed(own, 255)
    steps = [
        one(small, "00_input_downscaled.png"),
        one(level(soft, F.col("v")), "01_blur_gray.png"),
        one(white, "02_foreground_mask.png"),
        one(overlay, "03_objects_overlay.png"),
        one(match_lines(small, lines, boxes), "04_best_side_matches.png"),
        each(shown, F.concat(F.lit("objects/"), number, F.lit("image.png"))),
        each(masks, F.concat(F.lit("objects/"), number, F.lit("mask.png"))),
        each(shown, F.concat(folder, F.lit("/image.png"))),
        each(masks, F.concat(folder, F.lit("/mask.png"))),
        each(sides_on_mask(own, sides), F.concat(folder, F.lit("/sides_on_mask.png"))),
        match_pictures(own, sides, matches).select(F.concat(F.col("m_image_id"), F.lit("/"), match_file(prefix="m_")).alias("name"), "y", "x", *RGB),
    ]
    if debug:
        raw = raster.threshold_mask(soft)
        steps += [
            one(small, "debug-low/01_load_downscale/00_input_downscaled.png"),
            one(level(gray, px.to_u8(F.col("v"))), "debug-low/02_blur/10_gray_u8.png"),
            one(level(soft, F.col("v")), "debug-low/02_blur/20_blur_gray_u8.png"),
            one(level(raw, F.when(F.col("fg"), 255).otherwise(0)), "debug-low/03_background_mask/30_mask_raw.png"),
            one(white, "debug-low/03_background_mask/31_mask_refined.png"),
            one(overlay, "debug-low/04_extract_objects/40_objects_overlay.png"),
            each(corners_on_mask(own, sides), F.concat(F.lit("debug-low/05_find_mask_borders/"), number, F.lit("_sides.png"))),
            each(swatches(sides), F.concat(F.lit("debug-low/05_find_mask_borders/"), number, F.lit("_colours.png"))),
        ]
    return images.packed(reduce(DataFrame.unionByName, steps), "name")


def save_run(pixels: DataFrame, path: str, p: solve.Params = solve.Params(), debug: bool = True) -> None:
    """Write a run's pictures under ``path``."""
    images.save_files(pictures(pixels, p, debug), path)


def observed(boxes: DataFrame) -> tuple[DataFrame, Observation]:
    """The objects with a counter of them and of their pixels, read from the observation after any action."""
    o = Observation("objects")
    return boxes.observe(o, F.count(F.lit(1)).alias("n_objects"), F.sum("n_px").alias("n_px")), o


def perimeter_summary(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, text): order statistics of each image's edge."""
    return stats.summary(raster.perimeter(pixels), ["image_id"], value).select("image_id", "text")
