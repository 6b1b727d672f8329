"""Plans and counters of tables that are far larger than the ones they are made of."""

import os

import pytest
from pyspark.sql import functions as F

from tesselle.operators import raster, stars
from tesselle.plans import catalog, views

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def sent_by_pixel(df):
    """Lines of the plan that send a table of pixels to all executors."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "BroadcastHashJoin" in x and " y#" in x.replace("[y#", " y#")]


@tables
def test_photos_are_not_sent_to_all_executors(spark):
    assert not sent_by_pixel(views.photos(spark, DATA))
    assert not sent_by_pixel(catalog.QUERIES["solve"](spark, DATA))


@tables
def test_objects_pixels_are_not_sent_to_all_executors(spark):
    assert not sent_by_pixel(catalog.QUERIES["corners_px"](spark, DATA))


def test_downscaled_grids_are_not_sent_to_all_executors(spark):
    i = spark.range(3).select(F.col("id").cast("int").alias("image_id"))
    pixels = raster.constant(i, 8, 8, 7)
    for small in (raster.downscale_bilinear(pixels, 1.6), raster.downscale_nearest(pixels, 2.0)):
        assert not [x for x in small._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "image_id" in x]
        assert {r.v for r in small.collect()} == {7}


def test_mark_of_very_many_edges(spark):
    n = 20_000_000
    e = spark.range(1, n + 1).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = stars.mark(e)
    assert got[0] == n
    assert stars.mark(e.repartition(3)) == got != stars.mark(e.withColumn("b", F.when(F.col("a") == 5, 3).otherwise(F.col("b"))))


@tables
def test_pictures_are_read_back_without_a_join_by_pixel(spark):
    plan = catalog.QUERIES["png_round_trip"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Join" in x for x in plan[: next(k for k, x in enumerate(plan) if "MapInArrow" in x)])
