import numpy as np
from helpers import back, pixels, rect, rhombus
from pyspark.sql import functions as F

from tesselle.functions import pixels as px
from tesselle.operators import raster


def window_any(m, r, f, outside):
    p = np.pad(m, r, constant_values=outside)
    return f([p[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy in range(2 * r + 1) for dx in range(2 * r + 1)], axis=0)


def test_morphology_on_rectangle_and_random(spark):
    rng = np.random.default_rng(1)
    images = [rect(32, 32, 8, 8, 23, 23), rhombus(32, 32, 15, 15, 9), rng.random((32, 32)) < 0.8]
    m = pixels(spark, images, "fg")
    for i, a in enumerate(images):
        assert (back(raster.erode(m, 2), "fg", a.shape, i) == window_any(a, 2, np.all, False)).all()
        assert (back(raster.dilate(m, 2), "fg", a.shape, i) == window_any(a, 2, np.any, False)).all()
    assert back(raster.erode(m, 2), "fg", (32, 32)).sum() == 144
    assert back(raster.dilate(m, 2), "fg", (32, 32)).sum() == 400
    assert raster.erode(m, 0) is m and raster.dilate(m, 0) is m


def test_single_pixel(spark):
    a = np.zeros((25, 25), bool)
    a[12, 12] = True
    m = pixels(spark, [a], "fg")
    assert raster.erode(m, 1).filter("fg").count() == 0
    assert raster.dilate(m, 2).filter("fg").count() == 25


def test_border_counts(spark):
    m = pixels(spark, [rect(60, 80, 10, 8, 60, 45)], "fg")
    b = back(raster.border_pixels(m), "border", (60, 80))
    assert b.sum() == 174 and not b[20, 20] and b[8, 10] and b[45, 60] and not b[0, 0]
    assert raster.border_pixels(pixels(spark, [rhombus(120, 140, 70, 60, 40)], "fg")).filter("border").count() == 164


def test_background_thresholds(spark):
    a = np.full((120, 160), 50)
    a[35:86, 50:111] = 200
    b = np.full((140, 200), 40)
    b[0, ::20] = b[-1, ::20] = 200
    b[50:96, 70:131] = 180
    p = pixels(spark, [a, b])
    assert {r.image_id: r.thr for r in raster.background_threshold(p).collect()} == {0: 75.0, 1: 60.0}
    fg = raster.threshold_mask(p)
    assert back(fg, "fg", a.shape)[60, 60] and not back(fg, "fg", a.shape)[0, 0]
    assert back(fg, "fg", b.shape, 1)[70, 100] and not back(fg, "fg", b.shape, 1)[10, 10]


def test_hole_is_closed(spark):
    a = np.full((130, 180), 60)
    a[40:96, 55:126] = 210
    a[60:71, 85:96] = 60
    p = pixels(spark, [a])
    raw, closed = raster.threshold_mask(p), raster.foreground_mask(p, "v", 6, 6)
    assert not back(raw, "fg", a.shape)[65, 90] and back(closed, "fg", a.shape)[65, 90]
    assert closed.filter("fg").count() >= raw.filter("fg").count()


def test_area_downscale_keeps_half_pixel_shift(spark):
    a = np.arange(64).reshape(8, 8)
    got = back(raster.downscale_area(pixels(spark, [a]), 4.0), "v", (2, 2))

    def cover(i):
        lo, hi = max(0.0, 4 * i - 0.5), min(8.0, 4 * i + 3.5)
        return np.array([max(0.0, min(hi, p + 1) - max(lo, p)) for p in range(8)])

    for j in range(2):
        for i in range(2):
            w = np.outer(cover(j), cover(i))
            assert got[j, i] == int(np.floor((w * a).sum() / w.sum() + 0.5))
    assert raster.downscale_area(pixels(spark, [a]), 0.25).count() == 4
    assert raster.downscale_area(pixels(spark, [a]), 1.5).count() == 25


def test_blur_impulse_and_edges(spark):
    a = np.zeros((7, 7))
    a[3, 3] = 1.0
    a[0, 0] = 2.0
    k = np.array(raster.gaussian_kernel(0.5))
    assert len(k) == 5 and abs(k.sum() - 1) < 1e-12
    p = np.pad(a, 2, mode="edge")
    rows = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, p)
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, rows)
    assert np.allclose(back(raster.gaussian_blur(pixels(spark, [a]), 0.5), "v", a.shape).astype(float), want)


def test_rounding_and_non_finite(spark):
    rows = [(0.5,), (1.5,), (-3.0,), (300.0,), (float("nan"),), (float("inf"),)]
    got = spark.createDataFrame(rows, "v double").select(px.to_u8(F.col("v")).alias("u")).collect()
    assert [r.u for r in got] == [1, 2, 0, 255, 0, 0]


def test_beside_pads(spark):
    a, b = np.ones((2, 3), int), np.full((4, 2), 5)
    got = back(raster.beside(pixels(spark, [a]), pixels(spark, [b])), "v", (4, 5))
    assert got[:2, :3].sum() == 6 and got[2:, :3].sum() == 0 and (got[:, 3:] == 5).all()
