import numpy as np
from helpers import pixels

from tesselle.operators import drawing
from tesselle.plans.solve import Params, solve
from tesselle.sources import images
from tesselle.streaming import photos


def photo():
    """Two pieces of a colour gradient that share an edge, pulled apart, on black."""
    h, w = 100, 170
    y, x = np.mgrid[:60, :60]
    left = np.stack([40 + 3 * y, 230 - 2 * y, 60 + 120 * (np.sin(y / 5.0) > 0)], axis=2)
    out = np.zeros((h, w, 3), np.uint8)
    out[20:80, 10:70] = np.clip(left, 41, 255)
    out[20:80, 100:160] = np.clip(left, 41, 255)
    return out


def test_png_round_trip_and_matches(spark, tmp_path):
    a = photo()
    p = pixels(spark, [a[:, :, 0].astype(int)]).withColumnRenamed("v", "r")
    for c, n in ((1, "g"), (2, "b")):
        p = p.join(pixels(spark, [a[:, :, c].astype(int)]).withColumnRenamed("v", n), ["image_id", "y", "x"])
    images.save_images(p, str(tmp_path / "in"))
    assert (tmp_path / "in" / "0000.png").exists()
    back = images.to_pixels(images.load_images(spark, str(tmp_path / "in"))).drop("a").persist()
    assert back.count() == 100 * 170
    assert back.select("y", "x", "r", "g", "b").exceptAll(p.select("y", "x", "r", "g", "b")).count() == 0
    small = Params(downscale=1.0, grow=1, shrink=3)
    m = solve(back, small).collect()
    assert {r.a for r in m} == {0, 1} and all(r.a != r.c and 0 <= r.dist <= 2 for r in m)
    q = photos.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), small)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(m)


def test_gray_png_is_replicated(spark, tmp_path):
    (tmp_path / "g.png").write_bytes(images.png(np.arange(12, dtype=np.uint8).reshape(3, 4)))
    rows = images.to_pixels(images.load_images(spark, str(tmp_path))).collect()
    assert len(rows) == 12 and all(r.r == r.g == r.b == 4 * r.y + r.x and r.a == 255 for r in rows)


def test_lines_and_overlay(spark):
    lines = spark.createDataFrame([(1, 10, 20, 29, 20), (2, 0, 0, 0, 0), (3, 5, 9, 2, 1)], "id int, x0 int, y0 int, x1 int, y1 int")
    px = drawing.line_pixels(lines, ["id"])
    assert px.filter("id = 1").count() == 20 and px.filter("id = 2").count() == 1 and px.filter("id = 3").count() == 9
    base = pixels(spark, [np.full((48, 64), 100)])
    layer = px.selectExpr("0 as image_id", "y", "x", "id as z", "200 + id as v")
    got = drawing.overlay(base, layer, ["v"])
    assert got.count() == 48 * 64 and got.filter("v > 100").count() == 30


def test_rectangles_and_scales(spark):
    r = spark.createDataFrame([(1, 2, 3, 6, 8)], "id int, x0 int, y0 int, x1 int, y1 int")
    assert drawing.rectangle_pixels(r, ["id"]).count() == 18
    a = np.array([[0.0, 5.0], [float("nan"), 10.0]])
    assert {(x.y, x.x): x.v for x in drawing.scale_by_max(pixels(spark, [a])).collect()} == {(0, 0): 0, (0, 1): 128, (1, 0): 0, (1, 1): 255}
