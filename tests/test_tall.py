"""Signals of planes taller than an image file may be."""

import numpy as np
import pytest

from pixelveil.functions import pixel
from pixelveil.operators import marking, tiles
from pixelveil.plans.backends import Marker, signal_array
from pixelveil.sources import planes, sinks

TALL = 65_600


def tall(spark):
    """A tall narrow plane."""
    return spark.range(TALL * 3).selectExpr("0L img", "id div 3 r", "id % 3 c", "pmod(xxhash64(id), 256) v")


def test_a_signal_is_as_tall_as_its_plane(spark):
    w = planes.make_signal(spark, TALL, 3).orderBy("r", "c").toPandas().w.to_numpy().reshape(TALL, 3)
    assert np.allclose(w, signal_array(TALL, 3))
    with pytest.raises(ValueError, match="at least 1"):
        planes.make_signal(spark, 0, 3)


def test_signals_of_far_places_stay_in_64_bits(spark):
    far = [0, 65_535, 40_000_000, 10**11]
    got = [x.w for x in spark.createDataFrame([(r,) for r in far], "r bigint").select(pixel.signal_value(planes.F.col("r"), planes.F.lit(5)).alias("w")).collect()]
    m = 2147483647
    a, b = ([(r * y + 5 * x + s) * f % m for r in far] for y, x, s, f in ((7919, 104729, pixel.SEED, 48271), (15485863, 32452843, 17, 16807)))
    want = np.sqrt(-2 * np.log((np.array(a) + 1) / 2147483648.0)) * np.cos(np.array(b) * 6.283185307179586 / m)
    assert np.allclose(got, want) and np.allclose(tiles.signal_block(np.array(far), np.full(4, 5), 1, 1).ravel(), want)


def test_a_tall_signal_is_stored_as_a_table(spark, tmp_path):
    sinks.write_signal(planes.make_signal(spark, TALL, 3), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).selectExpr("count(*)", "max(r)", "max(c)").first() == (TALL * 3, TALL - 1, 2)


def test_a_tall_plane_is_marked_by_windows(spark):
    """The deterministic signal as a table gives what the computed one gives."""
    px, signal = tall(spark), planes.make_signal(spark, TALL, 3)
    a, b = marking.embed(px, signal).select("img", "r", "c", "y"), marking.embed(px).select("img", "r", "c", "y")
    assert a.count() == TALL * 3 and not a.exceptAll(b).count()


def test_a_tall_plane_is_marked_by_tiles(spark):
    px, signal = tall(spark), planes.make_signal(spark, TALL, 3, 7)
    a, b = tiles.embed(px, signal).select("img", "r", "c", "y"), marking.embed(px, signal).select("img", "r", "c", "y")
    assert a.count() == TALL * 3 and not a.exceptAll(b).count()


def test_a_tall_plane_is_detected(spark):
    signal = planes.make_signal(spark, TALL, 3, 7)
    marked = marking.embed(tall(spark), signal, "NVF").selectExpr("img", "r", "c", "y v").localCheckpoint()
    found = marking.detect(marked, signal, "NVF").first().correlation
    assert found > 0.01 and abs(tiles.detect(marked, signal, "NVF").first().correlation - found) < 1e-9


def test_a_tall_signal_is_read_from_segments_and_from_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SEGMENT_BYTES", 200_000)
    sinks.write_signal_file(planes.make_signal(spark, TALL, 3), str(tmp_path / "w"))
    want = signal_array(TALL, 3).ravel()
    (tmp_path / "w.bin").write_bytes(b"".join(x.read_bytes() for x in sorted((tmp_path / "w").glob("*.f32"))))
    for path in ("w", "w.bin"):
        got = planes.read_signal(spark, str(tmp_path / path), TALL, 3).orderBy("r", "c").toPandas()
        assert (got.r * 3 + got.c).tolist() == list(range(TALL * 3)) and np.allclose(got.w, want, atol=1e-6)
    with pytest.raises(ValueError, match="at least 1"):
        planes.read_signal(spark, str(tmp_path / "w"), 0, 3)


def test_a_marker_of_a_tall_signal(spark, tmp_path):
    sinks.write_signal_file(planes.make_signal(spark, TALL, 3), str(tmp_path / "w"))
    px = tall(spark)
    marked = Marker.create(spark, TALL, 3, str(tmp_path / "w")).embed(px).select("img", "r", "c", "y")
    plain = tiles.embed(px).selectExpr("img", "r", "c", "y z")
    assert marked.join(plain, ["img", "r", "c"]).selectExpr("count(*)", "max(abs(y - z)) <= 1").first() == (TALL * 3, True)  # floats of 32 bits
    with pytest.raises(ValueError, match="at least 1"):
        Marker(0, 3, px)
