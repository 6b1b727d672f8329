import pytest
from pyspark.sql import functions as F

from tesselle.functions import geometry, pixels, rng, stats


def model(seed, n):
    g = rng.Random(seed)
    return [g.u32() for _ in range(n)]


def test_rng_matches_integer_model(spark):
    seeds = [11, rng.DEFAULT_SEED, 0, 2**32 - 1, 2**32 - rng.MIX_ADD]
    df = spark.createDataFrame([(s,) for s in seeds], "s long")
    got = {}
    for r in rng.stream(df, "s", 130).collect():
        got.setdefault(r.s, {})[r.i] = r.u32
    for s in seeds:
        assert [got[s][i] for i in range(130)] == model(s, 130)
    assert model(2**32 - rng.MIX_ADD, 3) == [0, 0, 0]  # the one seed that mixes to zero


def test_rng_ranges(spark):
    df = rng.stream(spark.createDataFrame([(7654321,)], "s long"), "s", 1500)
    u = F.col("u32")
    r = df.agg(F.min(rng.unit_float(u)).alias("lo"), F.max(rng.unit_float(u)).alias("hi"), F.min(rng.int_between(u, 9, 4)).alias("a"), F.max(rng.int_between(u, 9, 4)).alias("b"), F.countDistinct("u32").alias("n")).first()
    draws = model(7654321, 1500)
    assert (r.lo, r.hi) == (min(draws) // 256 / 2**24, max(d // 256 for d in draws) / 2**24) and (r.a, r.b, r.n) == (4, 9, len(set(draws)))
    assert [x.v for x in df.orderBy("i").select(rng.int_between(u, 4, 9).alias("v")).collect()] == [4 + (d * 6 >> 32) for d in draws]
    assert [x.v for x in df.select(rng.int_between(u, -8, -8).alias("v")).distinct().collect()] == [-8]


def quantile(v, p):
    """By hand: the value at place p / 100 * (n - 1) of the sorted values, in between by proportion."""
    v = sorted(v)
    at = p / 100 * (len(v) - 1)
    k = int(at)
    return v[k] + (at - k) * (v[min(k + 1, len(v) - 1)] - v[k])


def test_summaries(spark):
    odd = [7, -2, 40, 13, 13, 5, 22]  # sorted: -2 5 7 13 13 22 40
    df = spark.createDataFrame([("a", v) for v in odd] + [("b", None)], "k string, v int")
    got = {r.k: r.text for r in stats.summary(df, ["k"], "v").collect()}
    assert got == {"a": "7 values - (min=-2 10%=2.2 median=13 90%=29.2 max=40)", "b": "0 values - (empty)"}
    halves = spark.createDataFrame([("a", x) for x in (-0.001, 2.5, 0.25, 1.125)], "k string, v double")
    assert stats.summary(halves, ["k"], "v", 2).first().text == "4 values - (min=0 10%=0.07 median=0.69 90%=2.09 max=2.50)"
    for bad in (-0.1, 100.5):
        with pytest.raises(ValueError):
            stats.percentile(F.col("v"), bad)


def test_percentiles_of_large_groups(spark, monkeypatch):
    """Bracketed by a sketch: ties, a hot group, nulls in keys and values, one row."""
    monkeypatch.setattr(stats, "ALL_ROWS", 50)
    monkeypatch.setattr(stats, "ACCURACY", 100)
    import random

    r = random.Random(2)
    rows = [("hot", float(r.randrange(40))) for _ in range(3000)] + [("wide", r.gauss(0, 1e6)) for _ in range(2000)] + [(None, float(k)) for k in range(120)] + [("one", 4.5), ("one", None), ("none", None)]
    rows += [("same", 3.0)] * 500
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ps = [0, 1, 33.3, 50, 99.9, 100]
    got = {x.k: x for x in stats.percentiles(df, ["k"], "v", ps).collect()}
    assert set(got) == {"hot", "wide", None, "one", "same"}
    for k, x in got.items():
        own = [v for g, v in rows if g == k and v is not None]
        assert x.n == len(own) and (x.v_min, x.v_max) == (min(own), max(own))
        assert all(abs(x[f"p{j}"] - quantile(own, p)) <= 1e-9 * max(1, abs(quantile(own, p))) for j, p in enumerate(ps))
    all_ = [v for _, v in rows if v is not None]
    assert abs(stats.percentiles(df, [], "v", [75]).first().p0 - quantile(all_, 75)) < 1e-9


def test_required_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None)], "k string, v double")
    least = stats.required(F.min("v"), F.count("v"), "minimum")
    assert df.agg(least.alias("m")).first().m == 1.0
    with pytest.raises(Exception, match="minimum of no values"):
        df.filter("v is null").agg(least.alias("m")).collect()


def test_previews(spark):
    df = spark.createDataFrame([("ten", 3 * i) for i in range(10)] + [("eleven", 100 - i) for i in range(11)] + [("one", 6), (None, 8)], "k string, v int")
    got = {r.k: r.text for r in stats.preview(df, ["k"], "v", ["v"]).collect()}
    assert got["ten"] == "10 values - [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]"
    assert got["eleven"] == "11 values - [90, 91, 92, 93, 94, ... 96, 97, 98, 99, 100]"
    assert got["one"] == "1 values - [6]" and got[None] == "1 values - [8]"


def test_points(spark):
    df = spark.createDataFrame([((-7, 4), (2, 9), (5, -12))], "p struct<x:int,y:int>, q struct<x:int,y:int>, r struct<x:int,y:int>")
    p, q, r = F.col("p"), F.col("q"), F.col("r")
    got = df.select(geometry.add(p, q).alias("a"), geometry.subtract(p, q).alias("s"), geometry.scale(p, F.lit(3)).alias("k"), geometry.dot(p, r).alias("d"), geometry.text(p).alias("t"), geometry.divide(p, F.lit(3), True).alias("h"), geometry.length(r).alias("l"), geometry.normalized(r).alias("n")).first()
    assert (tuple(got.a), tuple(got.s), tuple(got.k)) == ((-5, 13), (-9, -5), (-21, 12))
    assert (got.d, got.t, tuple(got.h), got.l) == (-83, "(-7, 4)", (-2, 1), 13.0) and abs(got.n.x - 5 / 13) < 1e-12 and abs(got.n.y + 12 / 13) < 1e-12
    big = spark.createDataFrame([((40_000, 30_000),)], "p struct<x:int,y:int>")
    with pytest.raises(Exception, match="(?i)overflow"):
        big.select(geometry.norm2(F.col("p"))).collect()
    none = spark.createDataFrame([((0.0, 0.0),)], "p struct<x:double,y:double>")
    with pytest.raises(Exception, match="no direction"):
        none.select(geometry.normalized(F.col("p"))).collect()
    with pytest.raises(Exception, match="(?i)zero"):
        df.select(geometry.divide(p, F.lit(0), True)).collect()


def test_boxes(spark):
    df = spark.createDataFrame([(10, 20), (12, 22)], "x int, y int")
    b = df.agg(geometry.bbox(F.col("x"), F.col("y")).alias("b")).first().b
    assert tuple(b) == (10, 20, 13, 23)
    none = df.filter("x > 99").agg(geometry.bbox(F.col("x"), F.col("y")).alias("b"), geometry.centroid(F.col("x"), F.col("y")).alias("c"))
    r = none.select("b", "c", geometry.box_width(F.col("b")).alias("w")).first()
    assert r.b is None and r.w == 0 and tuple(r.c) == (0, 0)


def test_names_and_angles(spark):
    r = spark.range(1).select(pixels.pixel_name(F.lit(7)).alias("a"), pixels.pixel_name(F.lit(12345)).alias("b"), pixels.degrees_apart(F.lit(350.0), F.lit(10.0)).alias("d"), pixels.wrap_degrees(F.lit(-30.0)).alias("w"), F.array(*pixels.hue_rgb(F.lit(120.0), F.lit(1.0))).alias("h")).first()
    assert (r.a, r.b, r.d, r.w, r.h) == ("0007", "12345", 20.0, 330.0, [0, 255, 0])
