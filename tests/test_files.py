"""Files written by tasks and read by ranges, settings texts, measured runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelveil.sources import files, planes, sinks
from pixelveil.sources.settings import Settings, as_flag, as_integer, read_settings
from pixelveil.streaming import frames as video


def listing(folder):
    return {str(x.relative_to(folder)): x.read_bytes() for x in folder.rglob("*") if x.is_file()}


def test_files_are_replaced_by_the_same_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/{i}.bin", bytearray(bytes([i]) * i)) for i in range(40)], "name string, content binary").repartition(6)
    for _ in range(2):
        files.write_files(rows, f"file://{tmp_path}/out")
        assert listing(tmp_path / "out") == {f"d{i % 3}/{i}.bin": bytes([i]) * i for i in range(40)}
    files.write_files(rows.limit(0), str(tmp_path / "none"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("a", bytearray(b"x")), ("../b", bytearray(b"y"))], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="not a relative name"):
        files.write_files(bad, str(tmp_path / "out"))
    assert not listing(tmp_path / "out")


def test_signals_in_segments_and_in_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SEGMENT_BYTES", 4 * 7 * 5)
    signal = planes.make_signal(spark, 23, 7).repartition(4)
    sinks.write_signal_file(signal, f"{tmp_path}/w")
    parts = listing(tmp_path / "w")
    assert sorted(parts) == [f"{i:012d}.f32" for i in range(0, 23, 5)]
    want = np.array([r.w for r in signal.orderBy("r", "c").collect()], "<f4")
    whole = b"".join(parts[k] for k in sorted(parts))
    assert whole == want.tobytes()
    (tmp_path / "w.bin").write_bytes(whole)
    for path in ("w", "w.bin"):
        got = planes.read_signal(spark, f"file://{tmp_path}/{path}", 23, 7).orderBy("r", "c").collect()
        assert [(r.r, r.c, r.w) for r in got] == [(*divmod(i, 7), float(v)) for i, v in enumerate(want)]
        with pytest.raises(ValueError, match="size is wrong"):
            planes.read_signal(spark, f"{tmp_path}/{path}", 23, 8)
    with pytest.raises(ValueError, match="160 of 23 x 7"):
        sinks.write_signal_file(signal.where("r + c > 0"), f"{tmp_path}/holes")


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "w.bin").write_bytes(np.arange(300_000, dtype="<f4").tobytes())
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", "200000")
    try:
        got = planes.read_signal(spark, str(tmp_path / "w.bin"), 3000, 100)
        assert got.rdd.getNumPartitions() >= 6
        assert got.where("w <> r * 100 + c").count() == 0 and got.count() == 300_000
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")


def frames(spark, n=9):
    rows = [(s, f, 4, 2, 4, bytearray([s, f] * 4), bytearray([f, s]), bytearray([9, f])) for s in range(2) for f in range(n + s)]
    return spark.createDataFrame(rows, video.FRAME).repartition(5)


def test_video_segments_are_a_streams_bytes_in_order(spark, tmp_path):
    f = frames(spark)
    sinks.write_video(f, str(tmp_path / "v"), 4)
    got = listing(tmp_path / "v")
    for s in range(2):
        whole = b"".join(got[k] for k in sorted(got) if k.startswith(f"{s}/"))
        assert whole == b"".join(bytes([s, i] * 4) + bytes([i, s, 9, i]) for i in range(9 + s))
    at = {(r.stream_id, r.name): (r.position, r.length) for r in sinks.segment_offsets(spark, str(tmp_path / "v")).collect()}
    assert at[1, "000000000008.yuv"] == (96, 24) and at[0, "000000000000.yuv"] == (0, 48) and len(at) == len(got)


def test_a_stream_writes_video_and_a_batch_run_twice_leaves_the_same(spark, tmp_path):
    frames(spark).write.parquet(str(tmp_path / "in"))
    for state in ("a", "b"):
        stream = sinks.write_video(video.read_stream(spark, str(tmp_path / "in"), 100), str(tmp_path / "v"), 4)
        stream.option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
        got = listing(tmp_path / "v")
        assert b"".join(got[k] for k in sorted(got) if k.startswith("1/")) == b"".join(bytes([1, i] * 4) + bytes([i, 1, 9, i]) for i in range(10))


def test_many_images_become_files_and_come_back(spark, tmp_path):
    rgb = spark.range(60).select((F.col("id") % 5).alias("img"), F.floor(F.col("id") / 20).alias("r"), (F.floor(F.col("id") / 5) % 4).alias("c"), *[(F.col("id") * k % 256).alias(x) for k, x in ((3, "red"), (5, "green"), (7, "blue"))])
    sinks.save_images(rgb.repartition(3), str(tmp_path / "i"), "W_ME")
    assert sorted(listing(tmp_path / "i")) == [f"{i}_W_ME.png" for i in range(5)]
    got = planes.read_images(spark, str(tmp_path / "i")).select(F.regexp_extract("path", r"(\d+)_W", 1).cast("bigint"), "r", "c", "red", "green", "blue")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rgb.collect()))


def test_bitmaps_and_unknown_kinds(spark, tmp_path):
    rgb = spark.range(21).select(F.lit(3).cast("bigint").alias("img"), F.floor(F.col("id") / 7).alias("r"), (F.col("id") % 7).alias("c"), F.col("id").alias("red"), (F.col("id") * 2).alias("green"), (F.col("id") + 200).alias("blue"))
    sinks.save_images(rgb, str(tmp_path / "b"), "", "bmp")
    got = planes.read_images(spark, str(tmp_path / "b")).select("r", "c", "red", "green", "blue").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rgb.select("r", "c", "red", "green", "blue").collect()))
    with pytest.raises(ValueError, match="not as gif"):
        sinks.save_images(rgb, str(tmp_path / "g"), "", "gif")


def test_a_marker_has_one_size(spark, tmp_path):
    from pixelveil.plans.backends import Marker, RelationalBackend

    px = spark.range(30 * 20).select(F.lit(0).cast("bigint").alias("img"), F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), (F.col("id") * 7919 % 200).alias("v"))
    sinks.write_signal_file(planes.make_signal(spark, 30, 20), str(tmp_path / "w"))
    made = [Marker.create(spark, 30, 20, str(tmp_path / "w"), **x) for x in ({}, {"backend": RelationalBackend})]
    a, b = (m.embed(px).select("r", "c", "y") for m in made)
    assert a.exceptAll(b).count() == 0 and a.count() == 600
    marked = a.select(F.lit(0).cast("bigint").alias("img"), "r", "c", F.col("y").alias("v"))
    assert made[0].detect(marked).first()[1] > made[0].detect(px).first()[1]
    for wrong in ({"p": 4}, {"psnr": 0.0}, {"border": "none"}):
        with pytest.raises(ValueError):
            Marker.create(spark, 30, 20, str(tmp_path / "w"), **wrong)
    with pytest.raises(ValueError, match="size is wrong"):
        Marker.create(spark, 30, 21, str(tmp_path / "w"))
    with pytest.raises(ValueError, match="pixels, the signal 30 x 20"):
        made[0].embed(px.where("r < 29"))


def test_settings_lines():
    s = Settings("; top\n# top\n[Paths] more ; x\nimage = a #1.png ; a comment\nvideo=b;c\n  ; not a value\n\td.mp4\nk = 09\nn = 0x1G\nm = -010\nnone = x1\n= empty\n[broken\nz = 1")
    assert s.text("paths", "IMAGE") == "a #1.png" and s.text("paths", "video") == "b;c\nd.mp4"
    assert [s.integer("paths", k, 7) for k in ("k", "n", "m", "none", "z")] == [0, 1, -8, 7, 1]


def test_settings_tables_equal_the_getters(spark):
    values = ["0x1f", "-12", "010", "09", "x", "", "Yes", "OFF", "1", " 5", "+0X10", "2"]
    text = "[A]\n" + "\n".join(f"k{i} = {v}" for i, v in enumerate(values))
    own = Settings(text)
    d = read_settings(spark.createDataFrame([("s", text), ("none", None), ("void", "")], "source string, text string"))
    got = {r.key: r for r in d.select("key", as_integer(F.col("value")).alias("n"), as_flag(F.col("value")).alias("f")).collect()}
    assert len(got) == len(values)
    for i in range(len(values)):
        assert (got[f"k{i}"].n, got[f"k{i}"].f) == (own.integer("a", f"k{i}", None), own.flag("a", f"k{i}", None))


def test_tables_on_the_way_are_removed(spark):
    from pixelveil.functions import tables

    before = tables.stored(spark.range(3), "before")
    on_the_way = []

    def make():
        middle = tables.stored(before.where("id > 0").coalesce(1), "middle")
        on_the_way.extend(middle.inputFiles())
        return tables.stored(middle, "late").select((F.col("id") * 2).alias("x"))

    out = tables.settled(make, "out")
    fs, at = tables.file_system(spark, on_the_way[0])
    assert sorted(r.x for r in out.collect()) == [2, 4]
    assert not fs.exists(at) and before.count() == 3


def test_runs_are_counted_and_timed(spark, tmp_path):
    kept, n, seconds = sinks.timed(frames(spark), str(tmp_path / "t"))
    assert n == kept.count() == 19 and seconds > 0
    times = sinks.RunTimes()
    spark.streams.addListener(times)
    try:
        q = video.write_stream(video.read_stream(spark, str(tmp_path / "t")), str(tmp_path / "o"), str(tmp_path / "c"))
        q.awaitTermination()
        for _ in range(100):
            if times.rows.get(str(q.id)) == 19:
                break
            spark._jsc.sc().listenerBus().waitUntilEmpty(2000)
        assert times.rows[str(q.id)] == 19 and times.seconds[str(q.id)] > 0
    finally:
        spark.streams.removeListener(times)
