"""Pixels that meet their image's scalars aren't broadcast, however small their file is."""

from pyspark.sql import functions as F

from pixelveil.functions.tables import stored
from pixelveil.operators import neighbourhood


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def flat(spark):
    """Flat pixels, whose file is smaller than their scalars."""
    return stored(spark.range(6400).selectExpr("id div 64 img", "id div 8 % 8 r", "id % 8 c", "5L v"), "flat")


def test_only_scalars_may_be_broadcast(spark):
    px = flat(spark)
    scalars = stored(px.groupBy("img").agg(F.max("r").alias("rows"), F.concat_ws("", F.collect_list(F.sha2(F.concat_ws(",", "img", "r", "c").cast("binary"), 512))).alias("k")), "scalars")
    got = neighbourhood.with_scalars(px, scalars)
    assert "BuildLeft" not in plan(got)
    assert got.where("k is null").count() == 0 and got.count() == 6400
    holes = neighbourhood.neighbours_by_join(px.where("r + c > 0"), 3, "edge")
    assert holes.count() == 6300 and "LeftOuter" in plan(holes)


def test_places_off_the_grid_are_dropped(spark):
    px = spark.createDataFrame([(1, 0, 0, 7), (1, None, 0, 7), (None, 0, 0, 7), (1, -1, 0, 7)], "img bigint, r bigint, c bigint, v bigint")
    scalars = spark.createDataFrame([(1, 0, 2.0)], "img bigint, rows bigint, k double")
    assert [tuple(x) for x in neighbourhood.with_scalars(px, scalars).select("img", "r", "c", "v", "k").collect()] == [(1, 0, 0, 7, 2.0)]
