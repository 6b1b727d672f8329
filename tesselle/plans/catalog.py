"""Registered queries and their equivalents in plain SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import geometry, pixels, rng, signals, stats
from tesselle.operators import contours, drawing, graphs, matching, neighbours, objects, raster
from tesselle.plans import report, views
from tesselle.plans import solve as photo
from tesselle.sources import images, shared

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(c, n: int = 6):
    return F.round(c, n)


# ---- pixels and thresholds ----


@query(f"WITH {views.COLOURS} SELECT image_id, y, x, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS v, round(least(greatest(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0), 255))::INT AS u8 FROM evr")
def gray_luma(spark, d):
    v = pixels.luma(F.col("r"), F.col("g"), F.col("b"))
    return views.colours(spark, d).select("image_id", "y", "x", _r(v).alias("v"), pixels.to_u8(v).alias("u8"))


@query(f"WITH {views.COLOURS} SELECT (y * 32 + x)::BIGINT AS pos, r // 2 AS r, g // 2 AS g, b // 2 AS b, CASE WHEN r > 100 THEN 120 ELSE 0 END AS dim, (x + 1 < 32 AND y + 1 < 24) AS has_next FROM evr")
def darken_dim(spark, d):
    y, x = F.col("y"), F.col("x")
    return views.colours(spark, d).select(pixels.linear_id(y, x, 32).alias("pos"), *[pixels.darken(F.col(c)).alias(c) for c in "rgb"], pixels.dim(F.col("r") > 100).alias("dim"), pixels.in_bounds(y + 1, x + 1, 32, 24).alias("has_next"))


_THRESHOLD = views.RASTER + f""", thr AS (
  SELECT image_id, least(greatest(1.5 * quantile_cont(v::DOUBLE, 0.9), 0), 255)::DOUBLE AS thr
  FROM rast WHERE y IN (0, {views.SIDE - 1}) OR x IN (0, {views.SIDE - 1}) GROUP BY image_id)"""


@query(f"WITH {_THRESHOLD} SELECT image_id, round(thr, 6) AS thr FROM thr")
def background_threshold(spark, d):
    return raster.background_threshold(views.raster(spark, d)).select("image_id", _r(F.col("thr")).alias("thr"))


@query(f"WITH {_THRESHOLD} SELECT image_id, y, x, v > thr AS fg FROM rast JOIN thr USING (image_id)")
def threshold_mask(spark, d):
    return raster.threshold_mask(views.raster(spark, d))


# ---- resampling ----


def _cover(t: str, p: str, n: int, inv: float) -> str:
    return f"(least(least({t} * {inv} + {inv} - 0.5, {n}), {p} + 1) - greatest(greatest({t} * {inv} - 0.5, 0), {p}))"


def _area_sql(inv: float) -> str:
    n, m = views.SIDE, max(1, math.floor(views.SIDE / inv + 0.5))
    w = f"{_cover('ty', 'y', n, inv)} * {_cover('tx', 'x', n, inv)}"
    return f"""WITH {views.RASTER} SELECT image_id, ty::INT AS y, tx::INT AS x, round(round(sum(({w})::DOUBLE * v) / sum(({w})::DOUBLE), 9))::INT AS v
      FROM rast, range({m}) a(ty), range({m}) b(tx) WHERE {_cover('ty', 'y', n, inv)} > 0 AND {_cover('tx', 'x', n, inv)} > 0 GROUP BY ALL"""


@query(_area_sql(4.0))
def downscale_area(spark, d):
    return raster.downscale_area(views.raster(spark, d), 4.0)


@query(_area_sql(2.5))
def downscale_area_fraction(spark, d):
    return raster.downscale_area(views.raster(spark, d), 2.5)


@query(f"WITH {views.RASTER} SELECT r.image_id, ty::INT AS y, tx::INT AS x, v FROM range(21) a(ty), range(21) b(tx) JOIN rast r ON r.y = least(floor((ty + 0.5) * 3), 63) AND r.x = least(floor((tx + 0.5) * 3), 63)")
def downscale_nearest(spark, d):
    return raster.downscale_nearest(views.raster(spark, d), 3.0)


@query(f"""WITH {views.RASTER}, t AS (
  SELECT ty, tx, floor((ty + 0.5) * 1.6 - 0.5) AS y0, floor((tx + 0.5) * 1.6 - 0.5) AS x0, (ty + 0.5) * 1.6 - 0.5 AS fy, (tx + 0.5) * 1.6 - 0.5 AS fx FROM range(40) a(ty), range(40) b(tx)),
 c AS (SELECT ty, tx, least(greatest(y0 + i, 0), 63)::INT AS y, least(greatest(x0 + j, 0), 63)::INT AS x,
   (CASE WHEN i = 1 THEN fy - y0 ELSE 1 - (fy - y0) END * CASE WHEN j = 1 THEN fx - x0 ELSE 1 - (fx - x0) END)::DOUBLE AS w FROM t, range(2) p(i), range(2) q(j))
 SELECT image_id, ty::INT AS y, tx::INT AS x, least(greatest(round(round(sum(w * v), 9)), 0), 255)::INT AS v FROM c JOIN rast USING (y, x) GROUP BY ALL""")
def downscale_bilinear(spark, d):
    return raster.downscale_bilinear(views.raster(spark, d), 1.6)


# ---- stencils ----


def _axis(part: str, order: str, f: str, r: int) -> str:
    return f"{f} OVER (PARTITION BY image_id, {part} ORDER BY {order} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


def _dilate_sql(src: str, r: int) -> str:
    return f"(SELECT image_id, y, x, {_axis('x', 'y', 'max(fg)', r)} AS fg FROM (SELECT image_id, y, x, {_axis('y', 'x', 'max(fg)', r)} AS fg FROM {src}))"


def _erode_sql(src: str, r: int) -> str:
    return f"""(SELECT a.image_id, a.y, a.x, count(*) FILTER (b.fg) = {(2 * r + 1) ** 2} AS fg FROM {src} a
      JOIN {src} b ON a.image_id = b.image_id AND b.y BETWEEN a.y - {r} AND a.y + {r} AND b.x BETWEEN a.x - {r} AND a.x + {r} GROUP BY ALL)"""


@query(f"WITH {views.MASK} SELECT * FROM {_dilate_sql('mask', 2)}")
def dilate(spark, d):
    return raster.dilate(views.mask(spark, d), 2)


@query(f"WITH {views.RASTER}, mask AS (SELECT image_id, y, x, v > 10 AS fg FROM rast) SELECT image_id, y, x, fg FROM {_erode_sql('mask', 1)}")
def erode(spark, d):
    return raster.erode(views.mask(spark, d, 10), 1)


@query(f"WITH {views.MASK}, grown AS {_dilate_sql('mask', 2)} SELECT image_id, y, x, fg FROM {_erode_sql('grown', 3)}")
def close_and_shrink(spark, d):
    return raster.erode(raster.dilate(views.mask(spark, d), 2), 3)


_NEAR = "JOIN mask b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"


@query(f"WITH {views.MASK} SELECT a.image_id, a.y, a.x, any_value(a.fg) AND 9 - count(*) FILTER (b.fg) >= 2 AS border FROM mask a {_NEAR} GROUP BY ALL")
def border_pixels(spark, d):
    return raster.border_pixels(views.mask(spark, d))


@query(f"""WITH {views.MASK}, n AS (SELECT a.image_id, a.y, a.x, any_value(a.fg) AS fg, count(*) AS cells, list(b.fg ORDER BY b.y, b.x) AS l FROM mask a {_NEAR} GROUP BY ALL)
  SELECT image_id, y, x, fg OR (cells = 9 AND ((l[4] AND l[6]) OR (l[2] AND l[8]) OR (l[1] AND l[9]) OR (l[3] AND l[7]))) AS fg FROM n""")
def fill_gaps(spark, d):
    return raster.fill_gaps(views.mask(spark, d))


def _gauss_ctes(sigma: float) -> str:
    """h and soft: the raster blurred along rows, then along columns too."""
    k = raster.gaussian_kernel(sigma)
    r = len(k) // 2
    kern = ", ".join(f"({i - r}, {v!r}::DOUBLE)" for i, v in enumerate(k))
    last = views.SIDE - 1
    return f"""{views.RASTER}, k(d, w) AS (VALUES {kern}),
      h AS (SELECT a.image_id, a.y, a.x, sum(b.v * w) AS v FROM rast a, k JOIN rast b ON a.image_id = b.image_id AND a.y = b.y AND b.x = least(greatest(a.x + d, 0), {last}) GROUP BY ALL),
      soft AS (SELECT a.image_id, a.y, a.x, sum(b.v * w) AS v FROM h a, k JOIN h b ON a.image_id = b.image_id AND a.x = b.x AND b.y = least(greatest(a.y + d, 0), {last}) GROUP BY ALL)"""


@query(f"WITH {_gauss_ctes(0.5)} SELECT image_id, y, x, round(v, 6) AS v FROM soft")
def gauss_blur(spark, d):
    return raster.gaussian_blur(views.raster(spark, d), 0.5).select("image_id", "y", "x", _r(F.col("v")).alias("v"))


def _sobel_ctes(of: str) -> str:
    return f""", g AS (
  SELECT a.image_id, a.y, a.x, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y)))::DOUBLE AS dx, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x)))::DOUBLE AS dy
  FROM {of} a JOIN {of} b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
  WHERE a.y BETWEEN 1 AND 62 AND a.x BETWEEN 1 AND 62 GROUP BY ALL),
 s AS (SELECT r.image_id, r.y, r.x, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy FROM rast r LEFT JOIN g USING (image_id, y, x))"""


_SOBEL = views.RASTER + _sobel_ctes("rast")


@query(f"WITH {_SOBEL} SELECT image_id, y, x, dx, dy, round(sqrt(dx * dx + dy * dy), 6) AS mag, CASE WHEN sqrt(dx * dx + dy * dy) <= 1e-6 THEN 0 ELSE round(degrees(atan2(dy, dx)) + CASE WHEN degrees(atan2(dy, dx)) < 0 THEN 360 ELSE 0 END, 6) END AS angle FROM s")
def sobel(spark, d):
    return raster.sobel(views.raster(spark, d)).select("image_id", "y", "x", "dx", "dy", _r(F.col("mag")).alias("mag"), _r(F.col("angle")).alias("angle"))


@query(f"""WITH {_gauss_ctes(1.0)} {_sobel_ctes("soft")},
  m AS (SELECT *, sqrt(dx * dx + dy * dy) AS mag, CASE WHEN sqrt(dx * dx + dy * dy) <= 1e-6 THEN 0 ELSE degrees(atan2(dy, dx)) + CASE WHEN atan2(dy, dx) < 0 THEN 360 ELSE 0 END END AS angle FROM s),
  t AS (SELECT *, floor((angle + 22.5) % 180 / 45)::INT AS sector FROM m),
  o AS (SELECT *, [0, -1, -1, -1][sector + 1] AS oy, [-1, -1, 0, 1][sector + 1] AS ox FROM t)
  SELECT o.image_id, o.y, o.x, o.mag > 0 AND o.mag >= coalesce(p.mag, 0) AND o.mag >= coalesce(q.mag, 0) AS edge FROM o
  LEFT JOIN m p ON p.image_id = o.image_id AND p.y = o.y + oy AND p.x = o.x + ox LEFT JOIN m q ON q.image_id = o.image_id AND q.y = o.y - oy AND q.x = o.x - ox""")
def edge_thinning(spark, d):
    return raster.non_maximum_suppression(raster.sobel(raster.gaussian_blur(views.raster(spark, d), 1.0)))


# ---- components ----


def _components_sql(eight: bool) -> str:
    near = "abs(m.y - c.y) <= 1 AND abs(m.x - c.x) <= 1" if eight else "abs(m.y - c.y) + abs(m.x - c.x) <= 1"
    return views.MASK + f""", fgs AS (SELECT image_id, y, x FROM mask WHERE fg),
      reach(image_id, y, x, comp) AS (
        SELECT image_id, y, x, y::BIGINT * 4294967296 + x FROM fgs
        UNION
        SELECT m.image_id, m.y, m.x, c.comp FROM reach c JOIN fgs m ON m.image_id = c.image_id AND {near}
          AND c.comp < m.y::BIGINT * 4294967296 + m.x),
      comps AS (SELECT image_id, y, x, min(comp) AS comp FROM reach GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_components_sql(True)} SELECT image_id::BIGINT AS image_id, y, x, comp FROM comps")
def components_8(spark, d):
    return objects.components(views.mask(spark, d))


@query(f"WITH RECURSIVE {_components_sql(False)} SELECT image_id::BIGINT AS image_id, y, x, comp FROM comps")
def components_4(spark, d):
    return objects.components(views.mask(spark, d), eight=False)


@query(f"""WITH RECURSIVE {_components_sql(True)}, o AS (
  SELECT image_id::BIGINT AS image_id, comp, min(x)::INT AS min_x, min(y)::INT AS min_y, (max(x) + 1)::INT AS max_x, (max(y) + 1)::INT AS max_y, count(*) AS n_px FROM comps GROUP BY ALL)
  SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY min_y, min_x, comp) - 1)::INT AS obj_id, comp, min_x, min_y, max_x, max_y, n_px FROM o""")
def objects_bbox(spark, d):
    return objects.objects(views.mask(spark, d))


def _customer_supplier(spark, d, lines: DataFrame) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (-(F.col("l_suppkey") + 1)).alias("b"))


@query()
def graph_components(spark, d):
    """Customers and suppliers that line items join; no SQL, as recursion over all of them is too slow."""
    return objects.graph_components(_customer_supplier(spark, d, views.table(spark, d, "lineitem")))


# ---- statistics ----

_SUM = "count(value) AS n, min(value) AS v_min, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS v_max"


@query(f"SELECT event_type, {_SUM} FROM events GROUP BY event_type")
def summary_stats(spark, d):
    s = stats.summary(views.table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "n", "v_min", _r(F.col("p10")).alias("p10"), _r(F.col("med")).alias("med"), _r(F.col("p90")).alias("p90"), "v_max")


@query("""SELECT l_returnflag, count(*) || ' values - (min=' || printf('%.2f', min(l_quantity)) || ' 10%=' || printf('%.2f', quantile_cont(l_quantity, 0.1)) || ' median=' || printf('%.2f', quantile_cont(l_quantity, 0.5))
  || ' 90%=' || printf('%.2f', quantile_cont(l_quantity, 0.9)) || ' max=' || printf('%.2f', max(l_quantity)) || ')' AS text FROM lineitem GROUP BY l_returnflag""")
def summary_text(spark, d):
    return stats.summary(views.table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 2).select("l_returnflag", "text")


@query("""WITH r AS (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)
  SELECT event_type, any_value(n) AS n, any_value(n) || ' values - [' || string_agg(event_id::VARCHAR, ', ' ORDER BY i) FILTER (i <= 5) || ', ... ' || string_agg(event_id::VARCHAR, ', ' ORDER BY i) FILTER (i > n - 5) || ']' AS text FROM r GROUP BY event_type""")
def preview_values(spark, d):
    return stats.preview(views.table(spark, d, "events"), ["event_type"], "event_id", ["event_id"])


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY ALL")
def percentiles(spark, d):
    by, ps = ["l_returnflag", "l_linestatus"], [25, 75, 99]
    got = stats.percentiles(views.table(spark, d, "lineitem"), by, "l_extendedprice", ps)
    return got.select(*by, *[_r(F.col(f"p{k}"), 4).alias(f"p{p}") for k, p in enumerate(ps)])


@query("SELECT event_type, round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 6) AS mean_angle FROM (SELECT event_type, degrees(atan2(sum(sin(radians(hour(ts) * 15))), sum(cos(radians(hour(ts) * 15))))) AS m FROM events GROUP BY event_type)")
def circular_mean(spark, d):
    return views.table(spark, d, "events").groupBy("event_type").agg(_r(stats.circular_mean(F.hour("ts") * 15)).alias("mean_angle"))


# ---- geometry ----


@query("SELECT p_brand, round(avg(p_size))::INT AS cx, round(avg(floor(p_retailprice)))::INT AS cy, min(p_size)::INT AS min_x, min(floor(p_retailprice))::INT AS min_y, (max(p_size) + 1)::INT AS max_x, (max(floor(p_retailprice)) + 1)::INT AS max_y FROM part GROUP BY p_brand")
def centroid_bbox(spark, d):
    x, y = F.col("p_size"), F.floor("p_retailprice").cast("int")
    g = views.table(spark, d, "part").groupBy("p_brand").agg(geometry.centroid(x, y).alias("c"), geometry.bbox(x, y).alias("b"))
    return g.select("p_brand", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "b.*")


@query("""WITH b AS (SELECT p_brand, min(p_size) AS x0, max(p_size) AS x1, min(floor(p_retailprice)) AS y0, max(floor(p_retailprice)) AS y1 FROM part WHERE p_size < 25 GROUP BY p_brand)
  SELECT p_partkey, p_size BETWEEN x0 AND x1 AND floor(p_retailprice) BETWEEN y0 AND y1 AS inside FROM part JOIN b USING (p_brand)""")
def contains_pixel(spark, d):
    p = views.table(spark, d, "part").withColumn("fy", F.floor("p_retailprice").cast("int"))
    b = p.filter("p_size < 25").groupBy("p_brand").agg(geometry.bbox(F.col("p_size"), F.col("fy")).alias("box"))
    return p.join(b, "p_brand").select("p_partkey", geometry.box_contains(F.col("box"), F.col("p_size"), F.col("fy")).alias("inside"))


@query("""WITH t AS (SELECT s_suppkey, s_nationkey::DOUBLE AS px, s_acctbal / 100 AS py FROM supplier),
  u AS (SELECT *, least(greatest((px * 20 + (py - 10) * 60) / 4000, 0), 1) AS t FROM t)
  SELECT s_suppkey, round(sqrt((px - t * 20) ** 2 + (py - 10 - t * 60) ** 2), 6) AS dist, round(abs(py), 6) AS off FROM u""")
def segment_distance(spark, d):
    s = views.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("px"), (F.col("s_acctbal") / 100).alias("py"))
    far = geometry.point_segment_distance(F.col("px"), F.col("py"), F.lit(0), F.lit(10), F.lit(20), F.lit(70))
    off = geometry.point_segment_distance(F.col("px"), F.col("py"), F.col("px"), F.lit(0), F.col("px"), F.lit(0))
    return s.select("s_suppkey", _r(far).alias("dist"), _r(off).alias("off"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS s, l_quantity AS x, l_suppkey AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
  SELECT a.l_orderkey, round(0.5 * sum(a.x * b.y - b.x * a.y), 4) AS area FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND b.i = a.i % a.n + 1 GROUP BY a.l_orderkey""")
def shoelace(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = views.table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).alias("i"), F.col("l_quantity").alias("x"), F.col("l_suppkey").alias("y"))
    return geometry.signed_area(p, ["l_orderkey"], "i").select("l_orderkey", _r(F.col("area"), 4).alias("area"))


@query("SELECT s_suppkey, '(' || (s_nationkey + 3) || ', ' || (s_suppkey - 5) || ')' AS shown, s_nationkey * 3 + s_suppkey * -5 AS dot, round(sqrt(s_nationkey * s_nationkey + s_suppkey * s_suppkey), 6) AS len, (s_suppkey // 2)::INT AS half FROM supplier")
def point_arithmetic(spark, d):
    p = geometry.point(F.col("s_nationkey").cast("long"), F.col("s_suppkey"))
    q = geometry.point(F.lit(3).cast("long"), F.lit(-5).cast("long"))
    return views.table(spark, d, "supplier").select("s_suppkey", geometry.text(geometry.add(p, q)).alias("shown"), geometry.dot(p, q).alias("dot"), _r(geometry.length(p)).alias("len"), geometry.divide(p, F.lit(2), whole=True)["y"].alias("half"))


# ---- signals ----


@query("""WITH k(d, w) AS (VALUES """ + ", ".join(f"({i - 3}, {v!r}::DOUBLE)" for i, v in enumerate(raster.gaussian_kernel(1.0))) + """),
  s AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i))
  SELECT a.vec_id, a.i::INT AS i, round(sum(b.v * w), 5) + 0.0::DOUBLE AS v FROM s a, k JOIN s b ON a.vec_id = b.vec_id AND b.i = least(greatest(a.i + d, 0), 63) GROUP BY ALL""")
def blur_1d(spark, d):
    s = views.signals(spark, d).select("vec_id", signals.blur(F.col("v"), 1.0, 1).alias("v"))
    return s.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", (_r(F.col("x"), 5) + 0.0).alias("v"))


@query("""SELECT vec_id, k::INT AS i, 0.0::DOUBLE + round((1 - (k * 63 / 9.0 - floor(k * 63 / 9.0)))::DOUBLE * embedding[floor(k * 63 / 9.0)::INT + 1]::DOUBLE
  + (k * 63 / 9.0 - floor(k * 63 / 9.0))::DOUBLE * embedding[least(floor(k * 63 / 9.0)::INT + 2, 64)]::DOUBLE, 5) AS v FROM embeddings, range(10) r(k)""")
def resample_signal(spark, d):
    s = views.signals(spark, d).select("vec_id", signals.resample(F.col("v"), 10).alias("v"))
    return s.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", (_r(F.col("x"), 5) + 0.0).alias("v"))


@query("""WITH don AS (SELECT event_type, epoch_us(ts) AS t, value FROM events WHERE event_id % 2 = 0), sam AS (SELECT event_type, epoch_us(ts) AS t FROM events WHERE event_id % 2 <> 0),
  lo AS (SELECT sam.event_type, sam.t, don.t AS t0, don.value AS v0 FROM sam ASOF LEFT JOIN don ON sam.event_type = don.event_type AND sam.t >= don.t),
  hi AS (SELECT lo.*, don.t AS t1, don.value AS v1 FROM lo ASOF LEFT JOIN don ON lo.event_type = don.event_type AND lo.t <= don.t)
  SELECT event_type, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE (1 - (t - t0) / (t1 - t0)) * v0 + (t - t0) / (t1 - t0) * v1 END, 4) AS value FROM hi""")
def asof_sample(spark, d):
    e = views.table(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value", "event_id")
    got = signals.bracket(e.filter("event_id % 2 <> 0"), e.filter("event_id % 2 = 0"), ["event_type"], "t", "value")
    return got.select("event_type", "t", _r(F.col("value"), 4).alias("value"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 100) AS v FROM embeddings),
  m AS (SELECT vec_id, v, list_avg(v) AS mean FROM s)
  SELECT vec_id, list_max(v) - list_min(v) <= 45 OR list_sort(list_transform(v, lambda x: abs(x - mean)))[63] <= 30 AS is_mono FROM m""")
def mono_filter(spark, d):
    v = F.transform("v", lambda x: x * 100)
    return views.signals(spark, d).select("vec_id", signals.is_monochrome([v], most_range=45, quantile=0.98, most_distance=30).alias("is_mono"))


_PAIRS = """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings),
  z AS (SELECT vec_id, label, list_transform(v, lambda x: x - m) AS v, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m)))) AS n FROM s),
  u AS (SELECT vec_id, label, list_transform(v, lambda x: x / n) AS v, list_reverse(list_transform(v, lambda x: x / n)) AS w FROM z),
  p AS (SELECT a.label::BIGINT AS a, a.vec_id AS b, c.label::BIGINT AS c, c.vec_id AS d, 1 - least(greatest(list_dot_product(a.v, c.w), -1), 1) AS dist FROM u a JOIN u c ON a.label <> c.label),
  r AS (SELECT *, (row_number() OVER (PARTITION BY a, b ORDER BY dist, c, d) - 1)::INT AS rank FROM p)"""


def _signals(spark, d) -> DataFrame:
    return views.signals(spark, d).select(F.lit(0).alias("image_id"), F.col("label").alias("obj_id"), F.col("vec_id").alias("side_id"), "v")


@query(_PAIRS + " SELECT a, b, rank, c, d, round(dist, 6) AS dist FROM r WHERE rank < 10")
def zncc_topk(spark: SparkSession, d: str) -> DataFrame:
    m = matching.best_matches(_signals(spark, d), 10, ("v",))
    return m.select("a", "b", "rank", "c", "d", _r(F.col("dist")).alias("dist"))


@query(_PAIRS + " SELECT a, b, c, d, round(dist, 6) AS dist FROM r WHERE rank = 0")
def zncc_best(spark, d):
    m = matching.best_matches(_signals(spark, d), 1, ("v",))
    return m.select("a", "b", "c", "d", _r(F.col("dist")).alias("dist"))


# ---- points, random numbers ----


@query("""WITH q AS (SELECT p_partkey AS qid, p_size + 0.25 AS x, p_retailprice AS y FROM part WHERE p_partkey % 50 = 0),
  n AS (SELECT qid, p_partkey AS id, (p_size - x) * (p_size - x) + (p_retailprice - y) * (p_retailprice - y) AS d2 FROM q, part)
  SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY d2, id) - 1)::INT AS rank, id, round(d2, 6) AS d2 FROM n QUALIFY rank < 8""")
def knn_2d(spark, d):
    p = views.points(spark, d)
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), (F.col("x") + 0.25).alias("x"), "y")
    return neighbours.knn_join(p, q, 8).select("qid", "rank", "id", _r(F.col("d2")).alias("d2"))


@query("""WITH q AS (SELECT p_partkey AS qid, p_size + 0.25 AS x, p_retailprice + 0.125 AS y, 1.0 + p_partkey % 4 AS r FROM part WHERE p_partkey % 50 = 0)
  SELECT qid, p_partkey AS id, round((p_size - x) * (p_size - x) + (p_retailprice - y) * (p_retailprice - y), 6) AS d2 FROM q JOIN part ON (p_size - x) * (p_size - x) + (p_retailprice - y) * (p_retailprice - y) <= r * r""")
def radius_2d(spark, d):
    p = views.points(spark, d)
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.125).alias("y"), (F.lit(1.0) + F.col("id") % 4).alias("radius"))
    return neighbours.radius_join(p, q).select("qid", "id", _r(F.col("d2")).alias("d2"))


_RNG = """WITH RECURSIVE
  m0 AS (SELECT n_nationkey AS seed, ((n_nationkey * 7919 + 2654435769) & 4294967295)::BIGINT AS x FROM nation),
  m1 AS (SELECT seed, (xor(x, x >> 16)::HUGEINT * 2246822507 & 4294967295)::BIGINT AS x FROM m0),
  m2 AS (SELECT seed, (xor(x, x >> 13)::HUGEINT * 3266489909 & 4294967295)::BIGINT AS x FROM m1),
  m3 AS (SELECT seed, xor(x, x >> 16) AS x FROM m2),
  st(seed, i, a) AS (
    SELECT seed, -1, x FROM m3
    UNION ALL
    SELECT seed, i + 1, xor(c, (c << 5) & 4294967295) FROM (
      SELECT seed, i, xor(b, b >> 17) AS c FROM (SELECT seed, i, xor(a, (a << 13) & 4294967295) AS b FROM st WHERE i < 149))),
  u AS (SELECT seed, i, a AS u32 FROM st WHERE i >= 0)"""


def _stream(spark, d) -> DataFrame:
    s = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"), (F.col("n_nationkey").cast("long") * 7919).alias("s"))
    return rng.stream(s, "s", 150).drop("s")


@query(_RNG + " SELECT seed, i, u32 FROM u")
def rng_u32(spark, d):
    return _stream(spark, d)


@query(_RNG + " SELECT seed, i, ((u32::HUGEINT * 7) >> 32)::INT - 3 AS small, CASE WHEN u32 > 2147483647 THEN u32 - 4294967296 ELSE u32 END::INT AS whole FROM u")
def rng_int(spark, d):
    u = F.col("u32")
    return _stream(spark, d).select("seed", "i", rng.int_between(u, 3, -3).alias("small"), rng.int_between(u, -(2**31), 2**31 - 1).alias("whole"))


@query(_RNG + " SELECT seed, i, (u32 >> 8)::DOUBLE / 16777216 AS f, round(-2.5 + 6 * ((u32 >> 8)::DOUBLE / 16777216), 9) AS g FROM u")
def rng_float(spark, d):
    u = F.col("u32")
    return _stream(spark, d).select("seed", "i", rng.unit_float(u).alias("f"), _r(rng.float_between(u, 3.5, -2.5), 9).alias("g"))


# ---- graphs and queues ----


#: Nations of the cycles that ``short_cycles`` lists.
CYCLE = 4

_NET = views.TRADE + f""", p(start, last, path, weight, closed) AS (
    SELECT src, dst, CASE WHEN src = dst THEN [src] ELSE [src, dst] END, w, src = dst FROM net WHERE dst >= src
    UNION ALL
    SELECT start, dst, CASE WHEN dst = start THEN path ELSE list_append(path, dst) END, weight + w, dst = start FROM p JOIN net ON src = last
    WHERE NOT closed AND (dst = start OR (dst > start AND NOT list_contains(path, dst) AND len(path) < {CYCLE})))"""


@query(f"WITH RECURSIVE {_NET} SELECT array_to_string(path, '-') AS path, weight FROM p WHERE closed")
def short_cycles(spark, d):
    """All cycles of up to CYCLE nations in the whole network."""
    return graphs.cycles_from(views.trade(spark, d), CYCLE).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "weight")


@query()
def heaviest_cycles(spark, d):
    return graphs.heaviest_cycles(views.trade(spark, d))


@query("""WITH l AS (SELECT event_type, user_id AS value, arg_max(floor(value), event_id) AS priority FROM events GROUP BY ALL)
  SELECT event_type, value, priority::BIGINT AS priority, (row_number() OVER (PARTITION BY event_type ORDER BY priority, value) - 1)::INT AS pos FROM l""")
def queue_order(spark, d):
    e = views.table(spark, d, "events").select("event_type", F.col("user_id").alias("value"), F.floor("value").alias("priority"), F.col("event_id").alias("op_no"))
    return graphs.queue_order(e, ["event_type"]).select("event_type", "value", "priority", "pos")


@query("SELECT event_id, list_filter([event_id % 5, event_id % 7, event_id % 11], lambda x: x % 2 = 0) AS evens, list_transform([event_id % 5, event_id % 7], lambda x: 'n' || x) AS names FROM events")
def filter_map_vector(spark, d):
    e = F.col("event_id")
    v = F.array(e % 5, e % 7, e % 11)
    return views.table(spark, d, "events").select("event_id", signals.filter_values(v, lambda x: x % 2 == 0).alias("evens"), signals.map_values(F.array(e % 5, e % 7), lambda x: F.concat(F.lit("n"), x.cast("string"))).alias("names"))


# ---- drawing ----

_LINES = "lines AS (SELECT s_suppkey AS id, (s_nationkey * 3)::INT AS x0, (s_suppkey % 50)::INT AS y0, (s_suppkey % 71)::INT AS x1, (floor(abs(s_acctbal))::BIGINT % 60)::INT AS y1 FROM supplier)"


def _lines(spark, d) -> DataFrame:
    return views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 3).cast("int").alias("x0"), (F.col("s_suppkey") % 50).cast("int").alias("y0"), (F.col("s_suppkey") % 71).cast("int").alias("x1"), (F.floor(F.abs("s_acctbal")).cast("long") % 60).cast("int").alias("y1"))


_WALK = f"""{_LINES}, w(id, step, x, y, x1, y1, dx, dy, sx, sy, err) AS (
    SELECT id, 0, x0, y0, x1, y1, abs(x1 - x0), -abs(y1 - y0), CASE WHEN x0 < x1 THEN 1 ELSE -1 END, CASE WHEN y0 < y1 THEN 1 ELSE -1 END, abs(x1 - x0) - abs(y1 - y0) FROM lines
    UNION ALL
    SELECT id, step + 1, x + CASE WHEN 2 * err >= dy THEN sx ELSE 0 END, y + CASE WHEN 2 * err <= dx THEN sy ELSE 0 END, x1, y1, dx, dy, sx, sy,
      err + CASE WHEN 2 * err >= dy THEN dy ELSE 0 END + CASE WHEN 2 * err <= dx THEN dx ELSE 0 END FROM w WHERE NOT (x = x1 AND y = y1))"""


@query(f"WITH RECURSIVE {_WALK} SELECT id, step, x, y FROM w")
def line_px(spark, d):
    return drawing.line_pixels(_lines(spark, d), ["id"])


@query(f"WITH RECURSIVE {_WALK} SELECT DISTINCT id, (x + i)::INT AS x, (y + j)::INT AS y FROM w, range(-1, 2) a(i), range(-1, 2) b(j) WHERE x + i BETWEEN 0 AND 63 AND y + j BETWEEN 0 AND 47")
def thick_line_px(spark, d):
    return drawing.thicken(drawing.line_pixels(_lines(spark, d), ["id"]), 2, 64, 48).select("id", "x", "y").distinct()


@query("""SELECT s_suppkey AS id, (s_nationkey + i)::INT AS x, (s_suppkey % 40 + j)::INT AS y FROM supplier, range(-8, 9) a(i), range(-8, 9) b(j)
  WHERE i * i + j * j <= (4 + s_suppkey % 4) ** 2 AND i * i + j * j >= (2 + s_suppkey % 4) ** 2""")
def circle_px(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cx"), (F.col("s_suppkey") % 40).cast("int").alias("cy"), (F.lit(3) + F.col("s_suppkey") % 4).cast("int").alias("r"), F.lit(1).alias("t"))
    return drawing.circle_pixels(s, ["id"])


@query(f"""WITH RECURSIVE {_WALK}, {views.RASTER}, l AS (SELECT (id // {views.PER_IMAGE})::INT AS image_id, y, x, max(id) AS z FROM w GROUP BY ALL)
  SELECT image_id, y, x, CASE WHEN z IS NULL THEN v ELSE 255 - (z % 100)::INT END AS v FROM rast LEFT JOIN l USING (image_id, y, x)""")
def overlay_px(spark, d):
    """Every supplier's line on the image of its group."""
    px = drawing.line_pixels(_lines(spark, d), ["id"])
    layers = px.select(F.floor(F.col("id") / views.PER_IMAGE).cast("int").alias("image_id"), "y", "x", F.col("id").alias("z"), (F.lit(255) - F.col("id") % 100).cast("int").alias("v"))
    return drawing.overlay(views.raster(spark, d), layers, ["v"])


_SEED7 = "(SELECT a AS s0 FROM (SELECT xor(x, x >> 16) AS a FROM (SELECT (xor(x, x >> 13)::HUGEINT * 3266489909 & 4294967295)::BIGINT AS x FROM (SELECT (xor(x, x >> 16)::HUGEINT * 2246822507 & 4294967295)::BIGINT AS x FROM (SELECT (7 + 2654435769)::BIGINT AS x)))))"


@query(f"""WITH RECURSIVE {views.RASTER}, lab AS (SELECT image_id, y, x, v // 16 AS comp FROM rast),
  f AS (SELECT image_id, comp, min(y * 64 + x) AS p FROM lab WHERE comp <> 0 GROUP BY ALL), k AS (SELECT image_id, comp, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS k FROM f),
  st(i, a) AS (SELECT -1, s0 FROM {_SEED7} UNION ALL SELECT i + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT i, xor(b, b >> 17) AS c FROM (SELECT i, xor(a, (a << 13) & 4294967295) AS b FROM st WHERE i < 60)))
  SELECT lab.image_id, y, x, coalesce(r.a & 255, 0)::INT AS r, coalesce(g.a & 255, 0)::INT AS g, coalesce(b.a & 255, 0)::INT AS b
  FROM lab LEFT JOIN k USING (image_id, comp) LEFT JOIN st r ON r.i = 3 * k LEFT JOIN st g ON g.i = 3 * k + 1 LEFT JOIN st b ON b.i = 3 * k + 2""")
def colorize_labels(spark, d):
    lab = views.raster(spark, d).select("image_id", "y", "x", F.floor(F.col("v") / 16).cast("int").alias("comp"))
    return drawing.label_colours(lab, seed=7, void=0)


@query(f"WITH {views.RASTER}, t AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM rast GROUP BY image_id) SELECT image_id, y, x, CASE WHEN hi > 0 THEN round(v * 255.0::DOUBLE / hi) ELSE 0 END::INT AS by_max, CASE WHEN hi > lo THEN round((v - lo) * 255.0::DOUBLE / (hi - lo)) ELSE 0 END::INT AS by_range FROM rast JOIN t USING (image_id)")
def visual_scales(spark, d):
    r = views.raster(spark, d)
    return drawing.scale_by_max(r).withColumnRenamed("v", "by_max").join(drawing.scale_min_max(r).withColumnRenamed("v", "by_range"), ["image_id", "y", "x"])


@query(f"WITH {views.RASTER} SELECT image_id, y, x::INT AS x, v FROM (SELECT image_id, y, x, v FROM rast UNION ALL SELECT image_id, y, x + 64, 255 - v FROM rast)")
def side_by_side(spark, d):
    r = views.raster(spark, d)
    return raster.beside(r, r.withColumn("v", F.lit(255) - F.col("v")))


# ---- outlines and the whole pipeline ----


def _sides(spark, d, samples: int = 40) -> DataFrame:
    return contours.sides(objects.own_pixels(views.scenes(spark, d), views.scene_mask(spark, d), ["r", "g", "b"]), samples=samples)


@query(f"WITH {views.SIDES} SELECT image_id::BIGINT AS image_id, obj_id, side_id, any_value(n)::INT AS n_px, round(sum(lx) / any_value(n))::INT AS cx, round(sum(ly) / any_value(n))::INT AS cy FROM (SELECT DISTINCT image_id, obj_id, side_id, n, i, lx, ly FROM pc) GROUP BY ALL")
def contour_sides(spark, d):
    return _sides(spark, d).select("image_id", "obj_id", "side_id", "n_px", "cx", "cy")


@query(f"WITH {views.samples_sql(10)} SELECT image_id::BIGINT AS image_id, obj_id, side_id, string_agg(u::VARCHAR, ',' ORDER BY k) AS reds FROM smp WHERE c = 0 GROUP BY ALL")
def sample_sides(spark, d):
    s = _sides(spark, d, 10)
    return s.select("image_id", "obj_id", "side_id", F.array_join(F.col("r").cast("array<string>"), ",").alias("reds"))


@query(f"""WITH {views.samples_sql(40)}, sv AS (SELECT image_id, obj_id, side_id, c, list(u::DOUBLE ORDER BY k) AS v FROM smp GROUP BY ALL),
  zm AS (SELECT *, list_avg(v) AS mean, list_sum(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))) AS sq FROM sv),
  z AS (SELECT * EXCLUDE v, list_transform(v, lambda x: (x - mean) / CASE WHEN sq < 1e-12 THEN 1 ELSE sqrt(sq) END) AS v FROM zm),
  pair AS (SELECT a.image_id, a.obj_id AS a, a.side_id AS b, e.obj_id AS c, e.side_id AS d,
      1 - sum(CASE WHEN least(a.sq, e.sq) < 1e-12 THEN CASE WHEN abs(a.mean - e.mean) < 1e-6 THEN 1 ELSE 0 END ELSE least(greatest(list_dot_product(a.v, list_reverse(e.v)), -1), 1) END) / 3 AS dist
    FROM z a JOIN z e ON a.image_id = e.image_id AND a.c = e.c AND a.obj_id <> e.obj_id GROUP BY ALL)
  SELECT image_id::BIGINT AS image_id, a::BIGINT AS a, b::BIGINT AS b, (row_number() OVER (PARTITION BY image_id, a, b ORDER BY dist, c, d) - 1)::INT AS rank, c::BIGINT AS c, d::BIGINT AS d, round(dist, 6) AS dist FROM pair QUALIFY rank < 10""")
def match_sides(spark, d):
    return matching.best_matches(_sides(spark, d), 10).select("image_id", "a", "b", "rank", "c", "d", _r(F.col("dist")).alias("dist"))


@query()
def solve(spark, d):
    """The whole chain from pixels to ranked matches; tested against a plain version."""
    colours = views.photos(spark, d)
    return photo.solve(colours, photo.Params(downscale=2.0, grow=1, shrink=2, samples=20)).select("image_id", "a", "b", "rank", "c", "d", _r(F.col("dist")).alias("dist"))


# ---- places, names, extents ----


@query("SELECT event_id, (event_id // 37)::INT AS y, (event_id % 37)::INT AS x, printf('%04d', event_id) AS name, least(abs(user_id * 7 % 360 - event_id % 360), 360 - abs(user_id * 7 % 360 - event_id % 360))::DOUBLE AS apart, ((user_id * 50) - 360 * floor(user_id * 50 / 360.0))::DOUBLE AS wrapped FROM events")
def places_names_angles(spark, d):
    y, x = pixels.linear_place(F.col("event_id"), 37)
    apart = pixels.degrees_apart((F.col("user_id") * 7 % 360).cast("double"), (F.col("event_id") % 360).cast("double"))
    return views.table(spark, d, "events").select("event_id", y.alias("y"), x.alias("x"), pixels.pixel_name(F.col("event_id")).alias("name"), apart.alias("apart"), pixels.wrap_degrees((F.col("user_id") * 50).cast("double")).alias("wrapped"))


@query(f"WITH {views.RASTER} SELECT image_id, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, max(abs(v))::DOUBLE AS top FROM rast WHERE y BETWEEN 1 AND {views.SIDE - 2} AND x BETWEEN 1 AND {views.SIDE - 2} GROUP BY image_id")
def inner_extent(spark, d):
    return stats.image_extent(views.raster(spark, d), skip_border=True)


@query(f"WITH {views.RASTER}, a AS (SELECT s_suppkey AS id, (s_suppkey // {views.PER_IMAGE})::INT AS image_id, (s_nationkey * 3)::INT AS y, (s_suppkey % 80)::INT AS x FROM supplier) SELECT id, image_id, y, x, v FROM a LEFT JOIN rast USING (image_id, y, x)")
def gather_px(spark, d):
    at = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / views.PER_IMAGE).cast("int").alias("image_id"), (F.col("s_nationkey") * 3).cast("int").alias("y"), (F.col("s_suppkey") % 80).cast("int").alias("x"))
    return raster.gather(views.raster(spark, d), at).select("id", "image_id", "y", "x", "v")


@query("""SELECT event_type, count(user_id) || ' values - (min=' || min(user_id) || ' 10%=' || regexp_replace(regexp_replace(printf('%.10f', quantile_cont(user_id, 0.1)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || ' median=' || regexp_replace(regexp_replace(printf('%.10f', quantile_cont(user_id, 0.5)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')
  || ' 90%=' || regexp_replace(regexp_replace(printf('%.10f', quantile_cont(user_id, 0.9)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || ' max=' || max(user_id) || ')' AS text FROM events GROUP BY event_type""")
def summary_whole(spark, d):
    return stats.summary(views.table(spark, d, "events"), ["event_type"], "user_id").select("event_type", "text")


@query("WITH " + views.TRADE.strip() + " SELECT src::BIGINT AS src, dst::BIGINT AS dst, w FROM net")
def checked_edges(spark, d):
    return graphs.check_edges(views.trade(spark, d), 25).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w")


# ---- objects and what shows them ----


def _own(spark, d) -> DataFrame:
    return objects.own_pixels(views.scenes(spark, d), views.scene_mask(spark, d), ["r", "g", "b"])


_SCENE_PX = "scene AS (SELECT image_id, obj_id, s, w, h, x0, y0, y - y0 AS ly, x - x0 AS lx, y, x, (x * x * 37 + y * 61 + x * y * 11 + s * s * 5) % 199 AS r, (x * y * 13 + y * y * 29 + s * x * 3) % 211 AS g, ((x + 3) * (y + 7) * (s + 17)) % 191 AS b FROM obj, range(48) a(y), range(64) b(x) WHERE y BETWEEN y0 AND y0 + h - 1 AND x BETWEEN x0 AND x0 + w - 1)"
_DRAWS = "st(i, a) AS (SELECT -1, s0 FROM {seed} UNION ALL SELECT i + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT i, xor(b, b >> 17) AS c FROM (SELECT i, xor(a, (a << 13) & 4294967295) AS b FROM st WHERE i < 40)))"


def _seed_sql(seed: int) -> str:
    return _SEED7.replace("(7 + ", f"({seed} + ")


@query(f"WITH {views.SIDES}, {_SCENE_PX} SELECT image_id::BIGINT AS image_id, obj_id, ly::INT AS y, lx::INT AS x, true AS fg, r::INT AS r, g::INT AS g, b::INT AS b FROM scene")
def object_crops(spark, d):
    return objects.crops(views.scenes(spark, d), views.scene_mask(spark, d), ["r", "g", "b"])


@query(f"WITH {views.SIDES} SELECT image_id::BIGINT AS image_id, obj_id, side_id, i::INT AS pos, lx::INT AS x, ly::INT AS y FROM px WHERE side_id < 3 UNION ALL SELECT image_id::BIGINT, obj_id, side_id, (i + 1)::INT, lx::INT, ly::INT FROM px WHERE side_id = 3 UNION ALL SELECT image_id::BIGINT, obj_id, side_id, 0, lx::INT, ly::INT FROM px WHERE side_id = 3 AND i = 0")
def outline_px(spark, d):
    """The outlines pixel by pixel: where they start, which way they run, where they are cut into sides."""
    s = _sides(spark, d, 2).select("image_id", "obj_id", "side_id", F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "p"))
    return s.select("image_id", "obj_id", "side_id", "pos", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


@query(f"WITH {views.samples_sql(10)} SELECT image_id::BIGINT AS image_id, obj_id, side_id AS y, k::INT AS x, max(u) FILTER (c = 0) AS r, max(u) FILTER (c = 1) AS g, max(u) FILTER (c = 2) AS b FROM smp GROUP BY ALL")
def swatch_px(spark, d):
    return report.swatches(_sides(spark, d, 10))


@query(f"""WITH RECURSIVE {views.SIDES}, {_SCENE_PX}, {_DRAWS.format(seed=_seed_sql(report.SEED))}
  SELECT image_id::BIGINT AS image_id, y::INT AS y, x::INT AS x, (a & 255)::INT AS r, ((a >> 8) & 255)::INT AS g, ((a >> 16) & 255)::INT AS b FROM scene JOIN st ON st.i = obj_id""")
def objects_overlay_px(spark, d):
    return report.objects_overlay(views.scenes(spark, d), views.scene_mask(spark, d))


@query(f"""WITH RECURSIVE {views.SIDES}, {_SCENE_PX},
  cs(i, a) AS (SELECT -1, {report.SEED}::BIGINT UNION ALL SELECT i + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT i, xor(b, b >> 17) AS c FROM (SELECT i, xor(a, (a << 13) & 4294967295) AS b FROM cs WHERE i < 4))),
  corner AS (SELECT image_id, obj_id, lx AS cx, ly AS cy FROM px WHERE i = 0),
  red AS (SELECT DISTINCT scene.image_id, scene.obj_id, ly, lx FROM scene JOIN corner USING (image_id, obj_id) WHERE abs(lx - cx) <= 2 AND abs(ly - cy) <= 2),
  on_side AS (SELECT image_id, obj_id, ly, lx, max(side_id) AS side_id FROM px GROUP BY ALL),
  t AS (SELECT s.image_id, s.obj_id, s.ly, s.lx, red.ly IS NOT NULL AS is_red, a FROM scene s LEFT JOIN red USING (image_id, obj_id, ly, lx) LEFT JOIN on_side USING (image_id, obj_id, ly, lx) LEFT JOIN cs ON cs.i = on_side.side_id)
  SELECT image_id::BIGINT AS image_id, obj_id, ly::INT AS y, lx::INT AS x, CASE WHEN is_red THEN 255 ELSE coalesce(a & 255, {report.GROUND}) END::INT AS r,
    CASE WHEN is_red THEN 0 ELSE coalesce((a >> 8) & 255, {report.GROUND}) END::INT AS g, CASE WHEN is_red THEN 0 ELSE coalesce((a >> 16) & 255, {report.GROUND}) END::INT AS b FROM t""")
def corners_px(spark, d):
    return report.corners_on_mask(_own(spark, d), _sides(spark, d, 2))


@query(f"WITH {_SOBEL}, m AS (SELECT *, sqrt(dx * dx + dy * dy) AS mag FROM s) SELECT image_id, x AS x0, y AS y0, round(x + 6.0 * dx / mag)::INT AS x1, round(y + 6.0 * dy / mag)::INT AS y1 FROM m WHERE y % 5 = 0 AND x % 5 = 0 AND mag > 300")
def gradient_arrows(spark, d):
    return drawing.arrow_lines(raster.sobel(views.raster(spark, d)), 300.0, 5, 6.0)


@query(f"WITH {_SOBEL}, t AS (SELECT image_id, max(abs(dx)) AS top FROM s GROUP BY image_id) SELECT s.image_id, y, x, round(127.5::DOUBLE + 127.5::DOUBLE * dx / top)::INT AS dx FROM s JOIN t USING (image_id)")
def signed_px(spark, d):
    return drawing.signed_view(raster.sobel(views.raster(spark, d)), "dx")


@query(f"""WITH {_SOBEL}, m AS (SELECT *, sqrt(dx * dx + dy * dy) AS mag, CASE WHEN sqrt(dx * dx + dy * dy) <= 1e-6 THEN 0 ELSE degrees(atan2(dy, dx)) + CASE WHEN atan2(dy, dx) < 0 THEN 360 ELSE 0 END END AS angle FROM s),
  t AS (SELECT image_id, max(mag) AS top FROM m GROUP BY image_id), v AS (SELECT m.image_id, y, x, mag / top AS v, angle / 60 AS h, unnest([5.0, 3.0, 1.0])::DOUBLE AS shift, unnest(['r', 'g', 'b']) AS c FROM m JOIN t USING (image_id)),
  k AS (SELECT *, (shift + h) - 6 * floor((shift + h) / 6) AS k FROM v)
  SELECT image_id, y, x, c, round(255 * (v - v * greatest(0, least(k, 4 - k, 1))), 3) AS u FROM k""")
def hue_px(spark, d):
    """The colours of directions before they are rounded to bytes."""
    g = raster.sobel(views.raster(spark, d))
    top = g.groupBy("image_id").agg(F.max("mag").alias("top"))
    g = g.join(top, "image_id").withColumn("v", F.col("mag") / F.col("top"))
    shares = F.array(*[F.struct(F.lit(n).alias("c"), c.alias("u")) for n, c in zip("rgb", pixels.hue_share(F.col("angle"), F.col("v")))])
    return g.select("image_id", "y", "x", F.explode(shares).alias("s")).select("image_id", "y", "x", "s.c", _r(F.col("s.u"), 3).alias("u"))


@query(f"""WITH {views.samples_sql(40)}, sv AS (SELECT image_id, obj_id, side_id, c, list(u::DOUBLE ORDER BY k) AS v FROM smp GROUP BY ALL),
  centre AS (SELECT image_id, obj_id, side_id, round(sum(lx) / any_value(n))::INT AS cx, round(sum(ly) / any_value(n))::INT AS cy FROM (SELECT DISTINCT image_id, obj_id, side_id, n, i, lx, ly FROM pc) GROUP BY ALL),
  zm AS (SELECT *, list_avg(v) AS mean, list_sum(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))) AS sq FROM sv),
  z AS (SELECT * EXCLUDE v, list_transform(v, lambda x: (x - mean) / CASE WHEN sq < 1e-12 THEN 1 ELSE sqrt(sq) END) AS v FROM zm),
  pair AS (SELECT a.image_id, a.obj_id AS a, a.side_id AS b, e.obj_id AS c, e.side_id AS d,
      1 - sum(CASE WHEN least(a.sq, e.sq) < 1e-12 THEN CASE WHEN abs(a.mean - e.mean) < 1e-6 THEN 1 ELSE 0 END ELSE least(greatest(list_dot_product(a.v, list_reverse(e.v)), -1), 1) END) / 3 AS dist
    FROM z a JOIN z e ON a.image_id = e.image_id AND a.c = e.c AND a.obj_id <> e.obj_id GROUP BY ALL),
  best AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY image_id, a, b ORDER BY dist, c, d) = 1)
  SELECT best.image_id::BIGINT AS image_id, a::BIGINT AS a, b::BIGINT AS b, p.cx AS x0, p.cy AS y0, q.cx AS x1, q.cy AS y1 FROM best
  JOIN centre p ON p.image_id = best.image_id AND p.obj_id = a AND p.side_id = b JOIN centre q ON q.image_id = best.image_id AND q.obj_id = c AND q.side_id = d""")
def best_match_lines(spark, d):
    s = _sides(spark, d)
    centres = s.select("image_id", "obj_id", "side_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return matching.best_lines(matching.best_matches(s, 1), centres)


@query(f"""WITH {views.SIDES}, {_SCENE_PX}, ground AS (SELECT image_id, y, x FROM (SELECT DISTINCT image_id FROM obj), range(96) a(y), range(128) b(x))
  SELECT g.image_id::BIGINT AS image_id, g.y::INT AS y, g.x::INT AS x, coalesce(s.r, 2)::INT AS r, coalesce(s.g, 2)::INT AS g, coalesce(s.b, 2)::INT AS b FROM ground g LEFT JOIN scene s ON s.image_id = g.image_id AND s.y = g.y // 2 AND s.x = g.x // 2""")
def png_round_trip(spark, d):
    """The photos written as PNG files to the shared folder and read back from there."""
    path = shared.new_folder(spark, "pictures")
    images.save_images(views.photos(spark, d), path)
    read = images.load_images(spark, path).withColumn("image_id", F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long"))
    return images.to_pixels(read).select("image_id", "y", "x", "r", "g", "b")
