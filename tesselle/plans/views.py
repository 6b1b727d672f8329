"""Rasters, signals, points and graphs derived from ordinary tables, for queries over data without images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.operators.raster import dense

SIDE = 64
#: Suppliers that make one gray image, and one scene.
PER_IMAGE, PER_SCENE = 34, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, images: int, height: int, width: int) -> DataFrame:
    """Every (image_id, y, x)."""
    i = F.col("id")
    return spark.range(images * height * width).select(F.floor(i / (height * width)).cast("int").alias("image_id"), F.floor(i % (height * width) / width).cast("int").alias("y"), (i % width).cast("int").alias("x"))


def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image for every PER_IMAGE suppliers, so that their number grows with the data."""
    return table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / PER_IMAGE).cast("int").alias("image_id")).distinct()


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images: whole-number sums of line items by order and part, modulo 256; an image for each group of suppliers."""
    v = (F.col("l_quantity").cast("int") * (F.col("l_linenumber") + 3)).cast("long")
    cells = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_suppkey") / PER_IMAGE).cast("int").alias("image_id"), (F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x")).agg((F.sum(v) % 256).cast("int").alias("v"))
    line = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = image_ids(spark, sf_dir).select("image_id", F.explode(line).alias("y")).select("image_id", "y", F.explode(line).alias("x"))
    return grid.join(cells, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


RASTER = f"""
rast AS (
  SELECT g.image_id, g.y, g.x, coalesce(c.v, 0)::INT AS v
  FROM (SELECT image_id, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT (s_suppkey // {PER_IMAGE})::INT AS image_id FROM supplier), range({SIDE}) b(y), range({SIDE}) c(x)) g
  LEFT JOIN (
    SELECT (l_suppkey // {PER_IMAGE})::INT AS image_id, (l_orderkey % {SIDE})::INT AS y, (l_partkey % {SIDE})::INT AS x,
      (sum(CAST(l_quantity AS INT) * (l_linenumber + 3)) % 256)::INT AS v
    FROM lineitem GROUP BY ALL) c USING (image_id, y, x))
"""


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, s, x0, y0, w, h): a rectangle for each supplier, twelve to a scene of 48 x 64 pixels, none touching another."""
    s = F.col("s_suppkey")
    slot = F.pmod(s, F.lit(PER_SCENE))
    return table(spark, sf_dir, "supplier").select(
        F.floor(s / PER_SCENE).cast("int").alias("image_id"), s.alias("s"), (slot % 4 * 16 + 1).cast("int").alias("x0"), (F.floor(slot / 4) * 16 + 1).cast("int").alias("y0"), (5 + F.col("s_nationkey") % 9).cast("int").alias("w"), (5 + s * 7 % 8).cast("int").alias("h")
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b): the pixels of the rectangles, coloured by place and supplier."""
    r = rectangles(spark, sf_dir).select("image_id", "s", "x0", "w", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)).alias("y"))
    r = r.select("image_id", "s", "y", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("w") - 1)).alias("x"))
    s, y, x = F.col("s"), F.col("y"), F.col("x")
    colours = (("r", (x * x * 37 + y * 61 + x * y * 11 + s * s * 5) % 199), ("g", (x * y * 13 + y * y * 29 + s * x * 3) % 211), ("b", ((x + 3) * (y + 7) * (s + 17)) % 191))
    return r.select("image_id", "y", "x", *[c.cast("int").alias(n) for n, c in colours])


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b): the scenes at twice their size on a dark ground."""
    i = rectangles(spark, sf_dir).select("image_id").distinct()
    twice = F.explode(F.sequence(F.lit(0), F.lit(1)))
    big = scenes(spark, sf_dir).withColumn("j", twice).withColumn("k", twice).select("image_id", (F.col("y") * 2 + F.col("j")).alias("y"), (F.col("x") * 2 + F.col("k")).alias("x"), "r", "g", "b")
    ground = i.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("x"))
    return ground.join(dense(big), ["image_id", "y", "x"], "left").select("image_id", "y", "x", *[F.coalesce(c, F.lit(2)).alias(c) for c in ("r", "g", "b")])


def scene_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark, sf_dir).select("image_id", "y", "x", F.lit(True).alias("fg"))


# Outlines run counter-clockwise from the upper left pixel, which stands at both ends; of its two copies the first is no
# corner, so the fourth side holds it twice.
SIDES = f"""
rect AS (
  SELECT (s_suppkey // {PER_SCENE})::INT AS image_id, s_suppkey AS s, (s_suppkey % {PER_SCENE} % 4 * 16 + 1)::INT AS x0, (s_suppkey % {PER_SCENE} // 4 * 16 + 1)::INT AS y0,
    5 + s_nationkey % 9 AS w, (5 + s_suppkey * 7 % 8)::INT AS h FROM supplier),
obj AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY y0, x0) - 1)::INT AS obj_id FROM rect),
side AS (
  SELECT image_id, obj_id, s, x0, y0, 0 AS side_id, 0 AS ax, h - 1 AS ay, 1 AS dx, 0 AS dy, w - 2 AS len, w - 1 AS n FROM obj
  UNION ALL SELECT image_id, obj_id, s, x0, y0, 1, w - 1, h - 1, 0, -1, h - 2, h - 1 FROM obj
  UNION ALL SELECT image_id, obj_id, s, x0, y0, 2, w - 1, 0, -1, 0, w - 2, w - 1 FROM obj
  UNION ALL SELECT image_id, obj_id, s, x0, y0, 3, 0, 0, 0, 1, h - 2, h FROM obj),
px AS (SELECT side.*, i, ax + i * dx AS lx, ay + i * dy AS ly, x0 + ax + i * dx AS x, y0 + ay + i * dy AS y FROM side, range(13) t(i) WHERE i <= len),
pc AS (SELECT image_id, obj_id, side_id, n, len, i, lx, ly, unnest([(x * x * 37 + y * 61 + x * y * 11 + s * s * 5) % 199, (x * y * 13 + y * y * 29 + s * x * 3) % 211, ((x + 3) * (y + 7) * (s + 17)) % 191])::DOUBLE AS v, unnest([0, 1, 2]) AS c FROM px)
"""


def samples_sql(n: int) -> str:
    """smp: (image_id, obj_id, side_id, c, k, u): ``n`` colours of every side by position along its chord."""
    return SIDES + f""",
line AS (SELECT image_id, obj_id, side_id, c, any_value(n) AS n, any_value(len) AS len, list(v ORDER BY i) AS v FROM pc GROUP BY ALL),
dense AS (
  SELECT image_id, obj_id, side_id, c, j, 4 * n AS m, (1 - (q - floor(q))) * v[floor(q)::INT + 1] + (q - floor(q)) * v[least(floor(q)::INT + 2, len + 1)] AS v
  FROM (SELECT *, j::DOUBLE / (4 * n - 1) * len AS q FROM line, range(60) t(j) WHERE j < 4 * n)),
dl AS (SELECT image_id, obj_id, side_id, c, m, least(12.0, greatest(0.6, 0.5 * (m - 1) / ({n} - 1)))::DOUBLE AS sigma, list(v ORDER BY j) AS v FROM dense GROUP BY ALL),
kern AS (SELECT m, d, exp(-(d * d) / (2 * sigma * sigma)) AS w FROM (SELECT DISTINCT m, sigma FROM dl), range(-40, 41) t(d) WHERE abs(d) <= greatest(1, ceil(3 * sigma))),
soft AS (
  SELECT image_id, obj_id, side_id, c, m, list(v ORDER BY j) AS v FROM (
    SELECT dl.image_id, obj_id, side_id, c, dl.m, j, sum(w * dl.v[least(greatest(j + d, 0), dl.m - 1) + 1]) / sum(w) AS v FROM dl, range(60) t(j), kern WHERE j < dl.m AND kern.m = dl.m GROUP BY ALL) GROUP BY ALL),
smp AS (
  SELECT image_id, obj_id, side_id, c, k, floor(least(greatest((1 - (p - floor(p))) * v[floor(p)::INT + 1] + (p - floor(p)) * v[least(floor(p)::INT + 2, m)], 0), 255) + 0.5)::INT AS u
  FROM (SELECT *, k::DOUBLE / ({n} - 1) * (m - 1) AS p FROM soft, range({n}) t(k)))
"""


def mask(spark: SparkSession, sf_dir: str, above: int = 110) -> DataFrame:
    return raster(spark, sf_dir).select("image_id", "y", "x", (F.col("v") > above).alias("fg"))


MASK = RASTER + ", mask AS (SELECT image_id, y, x, v > 110 AS fg FROM rast)"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 32x24 colour image of events by user and hour: red, green and blue from three kinds of event."""
    e = table(spark, sf_dir, "events")
    kinds = {"r": "view", "g": "click", "b": "purchase"}
    top = [F.max(F.when(F.col("event_type") == kind, F.floor("value"))).alias(c) for c, kind in kinds.items()]
    cells = e.groupBy(F.hour("ts").cast("int").alias("y"), (F.col("user_id") % 32).cast("int").alias("x")).agg(*top)
    shown = [F.least(F.coalesce(c, F.lit(0)), F.lit(255)).cast("int").alias(c) for c in kinds]
    return grid(spark, 1, 24, 32).join(cells, ["y", "x"], "left").select("image_id", "y", "x", *shown)


COLOURS = """
evr AS (
  SELECT g.image_id, g.y, g.x, least(coalesce(r, 0), 255)::INT AS r, least(coalesce(gr, 0), 255)::INT AS g, least(coalesce(b, 0), 255)::INT AS b
  FROM (SELECT 0 AS image_id, y::INT AS y, x::INT AS x FROM range(24) a(y), range(32) b(x)) g
  LEFT JOIN (
    SELECT hour(ts)::INT AS y, (user_id % 32)::INT AS x, max(CASE WHEN event_type = 'view' THEN floor(value) END) AS r,
      max(CASE WHEN event_type = 'click' THEN floor(value) END) AS gr, max(CASE WHEN event_type = 'purchase' THEN floor(value) END) AS b
    FROM events GROUP BY ALL) c USING (y, x))
"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v array<double>)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points by size and price."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): line items between a supplier's and a customer's nation, their number as weight."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s, c = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    return j.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("w"))


TRADE = """
net AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*)::DOUBLE AS w
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY ALL)
"""
