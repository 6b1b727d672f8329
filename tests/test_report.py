import struct

import numpy as np
import pytest
from helpers import pixels, rect
from pyspark.sql import functions as F

from tesselle.functions import pixels as px
from tesselle.functions import rng, stats
from tesselle.operators import contours, drawing, matching, objects, raster
from tesselle.plans import report
from tesselle.plans.solve import Params
from tesselle.sources import images
from tesselle.sources.jpeg import jpeg


def test_overlays_and_names(spark):
    mask = rect(30, 60, 4, 5, 15, 20) | rect(30, 60, 30, 5, 41, 20)
    y, x = np.mgrid[:30, :60]
    m = pixels(spark, [mask], "fg").persist()
    rgb = pixels(spark, [np.where(mask, 40 + 7 * y + x % 30, 0)]).select("image_id", "y", "x", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b")).persist()
    boxes = objects.objects(m).persist()
    sides = contours.sides(objects.crops(rgb, m, ["r", "g", "b"]), samples=12).persist()
    draws = rng.Random(report.SEED)
    shades = [draws.u32() for _ in range(2)]
    over = {(r.y, r.x): (r.r, r.g, r.b) for r in report.objects_overlay(rgb, m).collect()}
    assert over[5, 4] == tuple(shades[0] >> s & 255 for s in (0, 8, 16)) and over[5, 30] == tuple(shades[1] >> s & 255 for s in (0, 8, 16))
    for view in (report.objects_overlay(rgb, m), report.sides_overlay(rgb, sides, boxes)):
        assert view.count() == 30 * 60
        assert view.filter("y = 0 and x = 0").select("r", "g", "b").first()[:] == (0, 0, 0)
    assert report.swatches(sides).count() == 2 * 4 * 12
    best = matching.best_matches(sides, 1)
    centres = sides.select("image_id", "obj_id", "side_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    lines = best.select("image_id", "a", "b", "c").join(matching.best_lines(best, centres), ["image_id", "a", "b"])
    drawn = report.match_lines(rgb, lines, boxes).persist()
    assert lines.count() == 8 and drawn.count() == 30 * 60 and drawn.filter("r = 255 and g = 0 and b = 0").count() > 15
    path = best.orderBy("a", "b").select(report.match_file().alias("p")).first().p
    assert path.startswith("objects_side_matches/0000/side0/0000-0_neighb0_0001-") and path.endswith(".png")
    seen, o = report.observed(boxes)
    seen.count()
    assert o.get["n_objects"] == 2
    text = report.perimeter_summary(rgb.withColumnRenamed("r", "v")).first().text
    assert text == "176 values - (min=0 10%=0 median=0 90%=0 max=0)"


def scene(h=44, w=80):
    """Three pieces with a pattern each on black."""
    y, x = np.mgrid[:h, :w]
    a = np.zeros((h, w, 3), np.int64)
    for k, x0 in enumerate((4, 30, 56)):
        own = (slice(6, 36), slice(x0, x0 + 18))
        for c in range(3):
            a[own + (c,)] = (60 + 13 * ((y * (2 + k) + x * (3 + c) + (x * y) // 7) % 15))[own]
    return a


def table(spark, a):
    h, w = a.shape[:2]
    return spark.createDataFrame([(0, y, x, *(int(v) for v in a[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")


SMALL = Params(downscale=1.0, grow=1, shrink=2, samples=12)


def test_all_pictures_of_a_run(spark, tmp_path):
    a = scene()
    out = tmp_path / "out"
    report.save_run(table(spark, a), str(out), SMALL)
    names = {str(f.relative_to(out)) for f in out.rglob("*.png")}
    want = {f"0/{n}" for n in ("00_input_downscaled.png", "01_blur_gray.png", "02_foreground_mask.png", "03_objects_overlay.png", "04_best_side_matches.png")}
    want |= {f"0/objects/000{k}{n}.png" for k in range(3) for n in ("image", "mask")}
    want |= {f"0/objects_side_matches/000{k}/{n}.png" for k in range(3) for n in ("image", "mask", "sides_on_mask")}
    want |= {f"0/debug-low/{n}.png" for n in ("01_load_downscale/00_input_downscaled", "02_blur/10_gray_u8", "02_blur/20_blur_gray_u8", "03_background_mask/30_mask_raw", "03_background_mask/31_mask_refined", "04_extract_objects/40_objects_overlay")}
    want |= {f"0/debug-low/05_find_mask_borders/000{k}_{n}.png" for k in range(3) for n in ("sides", "colours")}
    assert want <= names
    pairs = sorted(n for n in names - want)
    assert len(pairs) == 3 * 4 * 8 and pairs[0].startswith("0/objects_side_matches/0000/side0/0000-0_neighb0_000")
    back = images.to_pixels(images.load_images(spark, str(out / "0" / "00_input_downscaled.png"))).collect()
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in back} == {(y, x): tuple(a[y, x]) for y in range(44) for x in range(80)}


def test_match_picture_and_masks(spark):
    a = scene()
    p = table(spark, a).persist()
    mask = p.select("image_id", "y", "x", (F.col("r") > 0).alias("fg")).persist()
    own = objects.own_pixels(p, mask, report.RGB).persist()
    sides = contours.sides(own, samples=12).persist()
    m = matching.best_matches(sides, 1).filter("a = 0 and b = 2").persist()
    best = m.first()
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in report.match_pictures(own, sides, m).collect()}
    assert len(got) == 30 * 36
    lit = {(r.obj_id, r.side_id): set(zip(r.ys, r.xs)) for r in sides.collect()}

    def shade(o, s):
        v = rng.Random(report.SEED ^ (o * 131 + s * 17)).u32()
        return tuple(v >> k & 255 for k in (0, 8, 16))

    for y in range(30):
        for x in range(18):
            for o, s, shift in ((0, 2, 0), (best.c, best.d, 18)):
                dark = tuple(int(v) // 4 for v in a[6 + y, (4, 30, 56)[o] + x])
                assert got[y, x + shift] == (shade(o, s) if (y, x) in lit[o, s] else dark)
    on = {(r.y, r.x): (r.r, r.g, r.b) for r in report.sides_on_mask(own, sides).filter("obj_id = 1").collect()}
    draws = rng.Random(report.SEED ^ 1)
    shades = [tuple(v >> k & 255 for k in (0, 8, 16)) for v in (draws.u32() for _ in range(4))]
    assert on[15, 9] == (60, 60, 60) and all(on[q] == shades[s] for s in range(4) for q in lit[1, s])
    corner = {(r.y, r.x): (r.r, r.g, r.b) for r in report.corners_on_mask(own, sides).filter("obj_id = 0").collect()}
    state = rng.step_int(report.SEED)
    assert corner[15, 9] == (90, 90, 90) and corner[0, 0] == corner[2, 2] == (255, 0, 0)
    some = next(q for q in sorted(lit[0, 0]) if 2 < q[1] < 15)
    assert corner[some] == tuple(state >> k & 255 for k in (0, 8, 16))


def test_gradient_views(spark):
    a = np.random.default_rng(4).normal(size=(9, 11))
    rows = [(0, y, x, float(a[y, x]), float(abs(a[y, x])), float((y * 40 + x * 33) % 360), float(a[y, x]), 1.0) for y in range(9) for x in range(11)]
    g = spark.createDataFrame(rows, "image_id long, y int, x int, v double, mag double, angle double, dx double, dy double").persist()
    top = np.abs(a).max()
    got = {(r.y, r.x): r.v for r in drawing.signed_view(g).collect()}
    assert got == {(y, x): int(np.floor(127.5 + 127.5 * a[y, x] / top + 0.5)) for y in range(9) for x in range(11)}
    import colorsys

    hue = {(r.y, r.x): (r.r, r.g, r.b) for r in drawing.angle_view(g).collect()}
    for (y, x), c in hue.items():
        want = colorsys.hsv_to_rgb((y * 40 + x * 33) % 360 / 360, 1.0, abs(a[y, x]) / top)
        assert all(abs(int(u) - 255 * v) <= 0.5 + 1e-6 for u, v in zip(c, want))
    arrows = {(r.x0, r.y0): (r.x1, r.y1) for r in drawing.arrow_lines(g, 0.5, 3, 4.0).collect()}
    assert set(arrows) == {(x, y) for y in range(0, 9, 3) for x in range(0, 11, 3) if abs(a[y, x]) > 0.5}
    for (x, y), (x1, y1) in arrows.items():
        n = np.hypot(a[y, x], 1.0)
        assert abs(x1 - (x + 4 * a[y, x] / n)) <= 0.5 + 1e-9 and abs(y1 - (y + 4 / n)) <= 0.5 + 1e-9
    flat = g.withColumn("v", F.lit(0.0))
    assert {r.v for r in drawing.signed_view(flat).collect()} == {128}


def test_extents(spark):
    a = np.array([[9.0, 1.0, 1.0, 1.0], [1.0, -3.0, np.inf, 1.0], [1.0, 2.0, np.nan, 1.0], [1.0, 1.0, 1.0, -7.0]])
    p = pixels(spark, [a])
    assert stats.image_extent(p).select("lo", "hi", "top").first()[:] == (-7.0, 9.0, 9.0)
    assert stats.image_extent(p, skip_border=True).select("lo", "hi", "top").first()[:] == (-3.0, 2.0, 3.0)


def test_segments_links_frames_points(spark):
    seg = spark.createDataFrame([(0, 0, 5, 5, 20, 5), (0, 1, 5, 15, 20, 25)], "image_id long, k int, x0 int, y0 int, x1 int, y1 int")
    layer = drawing.segment_layers(seg, 9).collect()
    draws = rng.Random(9)
    shades = [tuple(v >> k & 255 for k in (0, 8, 16)) for v in (draws.u32(), draws.u32())]
    assert {(r.r, r.g, r.b) for r in layer} == set(shades)
    assert {(r.x, r.y) for r in layer if (r.r, r.g, r.b) == shades[0]} == {(x, 5) for x in range(5, 21)} | {(5 + i, 5 + j) for i in range(-4, 5) for j in range(-4, 5) if 4 <= i * i + j * j <= 16}
    links = spark.createDataFrame([(0, 0, 1, None), (0, 1, -1, 0)], "image_id long, k int, to_start int, to_end int")
    red = {(r.x, r.y) for r in drawing.red_links(seg, links).collect()}
    assert {(20, 5), (5, 15)} <= red and len(red) == 16  # both lines join the same two points
    rect_ = spark.createDataFrame([(1, 10, 10, 14, 12)], "id int, x0 int, y0 int, x1 int, y1 int")
    assert drawing.frame_pixels(rect_, ["id"], 2).count() == 2 * (5 + 3) - 4 + 2 * (7 + 5) - 4
    pts = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (0, -1, 0), (0, 0, 9)], "image_id long, x int, y int")
    assert [(r.x, r.y) for r in drawing.mask_points(pts, 5, 5).collect()] == [(1, 1)]


def test_places_gathers_and_constants(spark):
    r = spark.range(1).select(*px.linear_place(F.lit(47), 10), px.linear_id(F.lit(4), F.lit(7), 10)).first()
    assert r[:] == (4, 7, 47)
    one = raster.constant(spark.createDataFrame([(3,)], "image_id long"), 4, 2, 9)
    assert one.count() == 8 and {(x.image_id, x.v) for x in one.collect()} == {(3, 9)}
    at = spark.createDataFrame([(3, 1, 2, "a"), (3, 5, 5, "b")], "image_id long, y int, x int, tag string")
    assert {(x.tag, x.v) for x in raster.gather(one, at).collect()} == {("a", 9), ("b", None)}


def test_jpeg_files_read_back(spark, tmp_path):
    y, x = np.mgrid[:37, :53]
    a = np.stack([128 + 90 * np.sin(x / 9.0), 255 * y / 36, 60 + 2 * x + 0 * y], axis=2).round().clip(0, 255).astype(np.int64)
    p = table(spark, a)
    images.save_images(p, str(tmp_path / "j"), "jpg", 95)
    back = images.to_pixels(images.load_images(spark, str(tmp_path / "j"))).collect()
    assert len(back) == 37 * 53 and np.mean([abs(int(u) - int(v)) for r in back for u, v in zip((r.r, r.g, r.b), a[r.y, r.x])]) < 2
    noise = np.random.default_rng(0).integers(0, 256, (20, 24, 3))
    worse, better = jpeg(noise, 5), jpeg(noise, 100)
    assert len(worse) < len(better)
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "q.jpeg").write_bytes(better)
    (tmp_path / "n" / "g.jpg").write_bytes(jpeg(noise[:, :, 0], 100))
    got = {r.origin.rsplit("/", 1)[1]: r for r in images.load_images(spark, str(tmp_path / "n")).collect()}
    seen = images.rgba(got["q.jpeg"].data, 24, 20, 3)[:, :, :3].astype(int)
    assert np.abs(seen - noise).max() <= 4
    assert np.abs(images.rgba(got["g.jpg"].data, 24, 20, got["g.jpg"].nChannels)[:, :, 0].astype(int) - noise[:, :, 0]).max() <= 2
    for bad in (0, 101):
        with pytest.raises(ValueError):
            jpeg(noise, bad)
    with pytest.raises(ValueError):
        images.save_images(p, str(tmp_path / "x"), "gif")


def test_bad_files_and_modes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.png(np.zeros((2, 2), np.uint8)))
    (tmp_path / "in" / "b.png").write_bytes(b"no picture")
    with pytest.raises(Exception, match="not a picture"):
        images.load_images(spark, str(tmp_path / "in")).collect()
    assert images.load_images(spark, str(tmp_path / "in"), skip_bad=True).count() == 1
    with pytest.raises(Exception):
        images.load_images(spark, str(tmp_path / "nowhere")).collect()
    p = table(spark, np.full((3, 4, 3), 7))
    images.save_images(p, str(tmp_path / "out"))
    images.save_images(p.withColumn("image_id", F.lit(5)), str(tmp_path / "out"))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["0000.png", "0005.png"]
    images.save_images(p.withColumn("image_id", F.lit(6)), str(tmp_path / "out"), mode="overwrite")
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["0006.png"]


def test_signed_images_choose_their_scale(spark, tmp_path):
    v = pixels(spark, [np.array([[-1.0, 3.0]]), np.array([[1.0, 4.0]])])
    images.save_signed(v, str(tmp_path / "s"))
    got = {}
    for r in images.load_images(spark, str(tmp_path / "s")).collect():
        got[r.origin.rsplit("/", 1)[1]] = images.rgba(r.data, r.width, r.height, r.nChannels)[0, :, 0].tolist()
    assert got == {"0000.png": [0, 255], "0001.png": [64, 255]}


def png_file(kind, depth, values, extra=b"", filters=None, interlaced=False):
    """A PNG file of (height, width, n) values, written plainly."""
    import zlib

    from tesselle.sources import pngfile

    h, w, n = values.shape

    def lines(v):
        out, before, step = b"", None, max(1, n * depth // 8)
        for y, row in enumerate(v):
            if depth == 16:
                raw = row.astype(">u2").tobytes()
            else:
                raw = np.packbits(((row.reshape(-1, 1) >> np.arange(depth)[::-1]) & 1).astype(np.uint8).ravel()).tobytes()
            before = before or bytes(len(raw))
            f = filters[y % len(filters)] if filters else 0
            coded = bytearray()
            for i, x in enumerate(raw):
                a, b, c = (raw[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
                paeth = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[0][2]
                coded.append((x - (0, a, b, (a + b) // 2, paeth)[f]) & 255)
            out += bytes([f]) + bytes(coded)
            before = raw
        return out

    data = b"".join(lines(values[y0::dy, x0::dx]) for x0, y0, dx, dy in pngfile.PASSES if values[y0::dy, x0::dx].size) if interlaced else lines(values)
    head = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, int(interlaced))
    return pngfile.SIGNATURE + images._chunk(b"IHDR", head) + extra + images._chunk(b"IDAT", zlib.compress(data)) + images._chunk(b"IEND", b"")


def test_unusual_png_files(spark, tmp_path):
    """Sixteen bits, gray with alpha and clear gray: decoded apart; other forms by the image source."""
    from tesselle.sources import pngfile

    r = np.random.default_rng(6)
    forms = {}
    for kind, n in pngfile.VALUES.items():
        for depth in (1, 2, 4, 8, 16):
            if depth < 8 and kind not in (0, 3) or depth == 16 and kind == 3:
                continue
            for interlaced in (False, True):
                v = r.integers(0, 1 << depth, (9, 11, n))
                extra, palette, clear = b"", r.integers(0, 256, (1 << min(depth, 8), 3)), None
                if kind == 3:
                    extra = images._chunk(b"PLTE", palette.astype(np.uint8).tobytes())
                if kind == 0 and depth > 1:
                    clear = int(v[0, 0, 0])
                    extra += images._chunk(b"tRNS", struct.pack(">H", clear))
                b = (lambda x: x >> 8) if depth == 16 else (lambda x: x * 255 // ((1 << depth) - 1))
                alpha = b(v[:, :, -1:]) if kind in (4, 6) else np.where(v == clear, 0, 255) if clear is not None else np.full((9, 11, 1), 255)
                colour = palette[v[:, :, 0]] if kind == 3 else np.repeat(b(v[:, :, :1]), 3, axis=2) if kind in (0, 4) else b(v[:, :, :3])
                forms[f"k{kind}d{depth}i{int(interlaced)}.png"] = (png_file(kind, depth, v, extra, [0, 1, 2, 3, 4], interlaced), np.concatenate([colour, alpha], axis=2))
    for name, (data, want) in forms.items():
        (tmp_path / name).write_bytes(data)
        got = pngfile.decode(data)
        assert (got == want[:, :, : got.shape[2]]).all() and (got.shape[2] == 4 or (want[:, :, 3] == 255).all()), name
    rows = images.load_images(spark, str(tmp_path)).collect()
    assert len(rows) == len(forms)
    for x in rows:
        want = forms[x.origin.rsplit("/", 1)[1]][1]
        assert (images.rgba(x.data, x.width, x.height, x.nChannels) == want).all(), x.origin
    with pytest.raises(ValueError):
        pngfile.decode(forms["k0d8i0.png"][0][:-30])
