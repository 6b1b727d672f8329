"""Small rasters from numpy arrays and back."""

import numpy as np


def pixels(spark, images, name="v"):
    rows = [(i, y, x, (bool(v) if name == "fg" else v.item())) for i, a in enumerate(images) for (y, x), v in np.ndenumerate(a)]
    kind = "boolean" if name == "fg" else "double" if images[0].dtype.kind == "f" else "int"
    return spark.createDataFrame(rows, f"image_id int, y int, x int, {name} {kind}")


def back(df, name, shape, image=0):
    out = np.zeros(shape, object)
    for r in df.filter(f"image_id = {image}").collect():
        out[r.y, r.x] = r[name]
    return out


def rect(h, w, x0, y0, x1, y1):
    m = np.zeros((h, w), bool)
    m[y0 : y1 + 1, x0 : x1 + 1] = True
    return m


def rhombus(h, w, cx, cy, r):
    y, x = np.mgrid[:h, :w]
    return abs(x - cx) + abs(y - cy) <= r
