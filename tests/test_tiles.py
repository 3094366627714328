"""Halo tiles against row and column windows, numpy and plain images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelveil.functions.pixel import exact_sum
from pixelveil.operators import marking, neighbourhood, predictor, tiles
from pixelveil.plans.backends import detect_plane, embed_plane
from pixelveil.sources import planes


def plane(h, w, seed=1):
    r, c = np.mgrid[:h, :w]
    return np.clip(128 + 50 * np.sin(r / 5) + 40 * np.cos(c / 7) + np.random.default_rng(seed).normal(0, 6, (h, w)), 0, 255).round()


#: One row or column, smaller than a window, whole tiles, a line more than tiles, and many small ones.
SIZES = [(1, 1), (1, 9), (7, 1), (3, 3), (16, 16), (17, 33), (40, 21), (8, 8), (8, 8)]


@pytest.fixture(scope="module")
def images(spark):
    rows = [(i, r, c, int(v)) for i, (h, w) in enumerate(SIZES) for (r, c), v in np.ndenumerate(plane(h, w, i))]
    return spark.createDataFrame(rows, "img bigint, r bigint, c bigint, v bigint").repartition(5).cache()


def same(a, b):
    names = sorted(a.columns)
    return sorted(map(tuple, a.select(names).collect())) == sorted(map(tuple, b.select(names).collect()))


@pytest.mark.parametrize("border", ["zero", "edge"])
@pytest.mark.parametrize("p", [3, 5, 9])
def test_neighbours_equal_windows(images, p, border):
    got = tiles.neighbours(images, p, border, side=16)
    assert same(got, neighbourhood.neighbours(images, p, border).select(got.columns))


@pytest.mark.parametrize("border", ["zero", "edge"])
def test_moments_of_all_windows_come_from_one_pass(images, border):
    got = tiles.moments(images, border=border, side=16)
    for p in (3, 5, 7, 9):
        assert same(got.where(F.col("p") == p).drop("p"), neighbourhood.moments(images, p, border).select("img", "r", "c", "total", "squares"))


@pytest.mark.parametrize(("p", "border"), [(3, "zero"), (5, "edge"), (9, "zero")])
def test_gram_equals_products(images, p, border):
    made = tiles.tiled(images, p // 2, 16)
    got = {r.img: r for r in tiles.gram(made, p, border).collect()}
    for i, (h, w) in enumerate(SIZES):
        wide = np.pad(plane(h, w, i), p // 2, mode="edge" if border == "edge" else "constant")
        near = np.stack([wide[a : a + h, b : b + w] for a in range(p) for b in range(p)]).reshape(p * p, -1)
        x = np.delete(near, p * p // 2, 0)
        assert np.array_equal(predictor.unpack(np.array([got[i].g]), p * p - 1)[0], x @ x.T)
        assert np.array_equal(got[i].b, x @ near[p * p // 2]) and got[i].rows == h - 1


@pytest.mark.parametrize("mask", ["ME", "NVF"])
@pytest.mark.parametrize(("p", "border"), [(3, "zero"), (3, "edge"), (7, "edge"), (9, "zero")])
def test_marks_and_scores_equal_whole_planes(spark, images, mask, p, border):
    some = images.where("img >= 4")
    got = tiles.embed(some, mask=mask, p=p, border=border, side=16).orderBy("img", "r", "c").toPandas()
    for i, d in got.groupby("img"):
        y, a = embed_plane(plane(*SIZES[i], i), mask=mask, p=p, border=border)
        assert (d.y.to_numpy() == np.floor(y).ravel()).mean() > 0.99 and (a is None) == d.strength.isna().all()
        assert a is None or abs(d.strength.iloc[0] - a) < 1e-6 * a
    marked = spark.createDataFrame(got[["img", "r", "c", "y"]].rename(columns={"y": "v"}))
    for r in tiles.detect(marked, mask=mask, p=p, border=border, side=16).collect():
        whole = got[got.img == r.img].y.to_numpy(float).reshape(SIZES[r.img])
        assert abs(r.correlation - detect_plane(whole, mask=mask, p=p, border=border)) < 1e-6


def test_a_stored_signal_meets_its_tiles(spark, images):
    one = images.where("img = 5")
    signal = planes.make_signal(spark, 17, 33, 7)
    a = tiles.embed(one, signal, side=16).select("r", "c", "y")
    assert same(a, marking.embed(one, signal).select("r", "c", "y"))
    marked = a.select(F.lit(5).cast("bigint").alias("img"), "r", "c", F.col("y").alias("v"))
    assert abs(tiles.detect(marked, signal, side=16).first()[1] - marking.detect(marked, signal).first()[1]) < 1e-9
    for run in (tiles.embed, tiles.detect):
        with pytest.raises(ValueError, match="17 x 33 pixels, the signal 17 x 32"):
            run(one, planes.make_signal(spark, 17, 32), side=16)


@pytest.mark.parametrize("mask", ["ME", "NVF"])
def test_colours_get_the_change_of_their_gray_plane(spark, images, mask):
    rgb = images.where("img >= 5").select("img", "r", "c", F.col("v").alias("red"), (F.lit(255) - F.col("v")).alias("green"), (F.col("v") * 7 % 256).alias("blue"), F.when((F.col("r") + F.col("c")) % 9 == 0, 0).otherwise(255).alias("alpha"))
    for d in (rgb, rgb.drop("alpha")):
        a, b = tiles.embed_rgb(d, mask=mask, side=16), marking.embed_rgb(d, mask=mask)
        assert a.columns == b.columns and a.dtypes == b.dtypes
        assert same(a.drop("strength"), b.drop("strength"))


def test_flat_and_singular_images_pass(spark):
    flat = spark.createDataFrame([(i, r, c, 7 if i else c) for i in range(2) for r in range(20) for c in range(20)], "img bigint, r bigint, c bigint, v bigint")
    out = tiles.embed(flat, border="edge", side=16).toPandas()
    assert out.strength.isna().all() and (out.y == np.where(out.img == 1, 7, out.c)).all()
    assert {r.correlation for r in tiles.detect(flat, border="edge", side=16).collect()} == {0.0}


@pytest.mark.parametrize("wrong", ["not (img = 6 and r = 20 and c = 3)", "not (img = 6 and r >= 16 and r < 32 and c < 16)", "not (img = 6 and r = 0)", "not (img = 6 and c = 20 and r = 39)"])
def test_holes_are_refused(images, wrong):
    with pytest.raises(Exception, match="image 6 has|has holes"):
        tiles.tiled(images.where(wrong), 1, 16).count()


def test_repeated_places_are_refused(images):
    with pytest.raises(Exception, match="has holes or repeated"):
        tiles.tiled(images.union(images.where("img = 6 and r = 20 and c = 3")), 1, 16).count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "img bigint, r bigint, c bigint, v bigint")
    assert tiles.embed(none).count() == tiles.detect(none).count() == tiles.moments(none).count() == 0


def test_tiles_bound_what_a_task_holds(spark):
    tall = spark.range(40 * 3000).select(F.lit(0).cast("bigint").alias("img"), F.floor(F.col("id") / 40).alias("r"), (F.col("id") % 40).alias("c"), (F.col("id") * 7919 % 251).alias("v"))
    made = tiles.tiled(tall, 4, 64)
    assert made.agg(F.max(F.size("v"))).first()[0] <= 72 * 72 and made.count() == 47
    plan = tiles.neighbours(tall, 3)._jdf.queryExecution().toString() + tiles.tiles(tall, 4)._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan


def test_exact_sums_and_scores_dont_depend_on_partitions(spark, images):
    x = np.random.default_rng(3).normal(0, 1, 5000) * np.exp(np.random.default_rng(4).uniform(-12, 12, 5000))
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    sums = {d.repartition(n).agg(exact_sum(F.col("x"))).first()[0] for n in (1, 7, 64)}
    assert len(sums) == 1 and abs(sums.pop() - x.sum()) < 1e-9
    scores = {tuple(sorted(map(tuple, f(images.where("img >= 5").repartition(n, "c")).collect()))) for n in (1, 7, 64) for f in (tiles.detect,)}
    assert len(scores) == 1
