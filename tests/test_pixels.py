"""Invariants of the pixel operators, and agreement between backends and with numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelveil.functions import pixel
from pixelveil.operators import marking, neighbourhood, predictor
from pixelveil.plans.backends import ArrowBackend, detect_plane, embed_plane, signal_array
from pixelveil.sources import planes
from pixelveil.sources.settings import Options, Settings, options
from pixelveil.streaming import frames as video


def smooth(h=40, w=48, seed=1):
    r, c = np.mgrid[:h, :w]
    return np.clip(128 + 50 * np.sin(r / 5) + 40 * np.cos(c / 7) + np.random.default_rng(seed).normal(0, 2, (h, w)), 0, 255).round()


def table(spark, plane, img=0):
    h, w = plane.shape
    return spark.createDataFrame([(img, i, j, int(plane[i, j])) for i in range(h) for j in range(w)], "img bigint, r bigint, c bigint, v bigint")


@pytest.mark.parametrize("border", ["zero", "edge"])
@pytest.mark.parametrize("p", [3, 5])
def test_neighbours_and_gram_match_numpy(spark, p, border):
    x = smooth(9, 7)
    wide = np.pad(x, p // 2, mode="edge" if border == "edge" else "constant")
    near = np.stack([wide[i : i + 9, j : j + 7] for i in range(p) for j in range(p) if (i, j) != (p // 2, p // 2)]).reshape(p * p - 1, -1)
    got = neighbourhood.neighbours(table(spark, x), p, border).orderBy("r", "c").toPandas()
    assert np.array_equal(got[neighbourhood.names(p)].to_numpy().T, near)
    g = predictor.gram(neighbourhood.neighbours(table(spark, x), p, border), p).first()
    assert np.array_equal(predictor.unpack(np.array([g.g], float), p * p - 1)[0], near @ near.T)


@pytest.mark.parametrize("mask", ["ME", "NVF"])
@pytest.mark.parametrize("border", ["zero", "edge"])
def test_backends_agree_and_marks_are_found(spark, mask, border):
    x = smooth()
    px = table(spark, x)
    a = marking.embed(px, mask=mask, border=border).orderBy("r", "c").toPandas()
    b = ArrowBackend.embed(px, mask=mask, border=border).orderBy("r", "c").toPandas()
    assert (a.y == b.y).mean() > 0.999 and abs(a.strength[0] - b.strength[0]) < 1e-6
    y = a.y.to_numpy().reshape(x.shape)
    score = detect_plane(y, mask=mask, border=border)
    found = marking.detect(table(spark, y), mask=mask, border=border).first().correlation
    assert abs(found - score) < 1e-6 and score > detect_plane(x, mask=mask, border=border) + 0.2


def test_psnr_before_clamping():
    x = smooth()
    w = signal_array(*x.shape)
    for p in (3, 5):
        y, a = embed_plane(np.full_like(x, 0) + x / 4 + 90, w, "NVF", p)
        assert abs(10 * np.log10(65025 / np.mean((y - (x / 4 + 90)) ** 2)) - 40) < 0.05


def test_flat_and_ramp_planes_pass_unchanged(spark):
    for plane in (np.full((12, 12), 7.0), np.tile(np.arange(12.0), (12, 1))):
        px = table(spark, plane)
        out = marking.embed(px, border="edge").toPandas()
        assert out.strength.isna().all()
        assert marking.detect(px, border="edge").first().correlation == 0.0
        assert np.array_equal(out.sort_values(["r", "c"]).y.to_numpy().reshape(12, 12), plane)


def test_rgb_adds_the_same_change_and_blackens_transparent_pixels(spark):
    x = smooth(16, 16).clip(60, 200)
    rows = [(0, i, j, int(x[i, j]), int(x[i, j]) - 20, int(x[i, j]) + 20, 0 if (i, j) == (3, 4) else 255) for i in range(16) for j in range(16)]
    rgb = spark.createDataFrame(rows, "img bigint, r bigint, c bigint, red bigint, green bigint, blue bigint, alpha int")
    out = marking.embed_rgb(rgb, quantize=False).where("alpha > 0").join(rgb.select("r", "c", F.col("red").alias("r0"), F.col("blue").alias("b0")), ["r", "c"])
    d = out.toPandas()
    assert np.allclose(d.red - d.r0, d.blue - d.b0)


def test_streams_equal_batches(spark, tmp_path):
    px = spark.createDataFrame([(1, f, i, j, int(smooth(8, 8, f)[i, j])) for f in range(7) for i in range(8) for j in range(8)], "stream_id bigint, frame_no bigint, r bigint, c bigint, v bigint")
    frames = video.pixels_to_frames(px)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frames.write.parquet(src)
    video.write_stream(video.embed_stream(video.read_stream(spark, src), 3), out, str(tmp_path / "ck")).awaitTermination()
    batch = {r.frame_no: r for r in video.embed_stream(spark.read.schema(video.FRAME).parquet(src), 3).collect()}
    before = {r.frame_no: r for r in frames.collect()}
    for r in spark.read.parquet(out).collect():
        assert r.y == batch[r.frame_no].y and r.u == before[r.frame_no].u
        assert (r.y == before[r.frame_no].y) == (r.frame_no % 3 != 0)
    scores = video.detect_stream(frames, 3).toPandas()
    assert sorted(scores.frame) == [1, 4, 7]
    assert video.frames_to_pixels(frames).exceptAll(px).count() == 0


def test_padded_lines(spark):
    x = smooth(4, 6).astype(np.uint8)
    padded = np.pad(x, ((0, 0), (0, 2))).tobytes()
    d = spark.createDataFrame([(0, 0, 6, 4, 8, bytearray(padded), bytearray(b"ab" * 3), bytearray(b"cd" * 3))], video.FRAME)
    assert video.compacted(d).first().y == bytearray(x.tobytes())
    marked = video.embed_stream(d, 1).first()
    assert len(marked.y) == 32 and bytes(marked.y[6:8]) == b"\0\0"


def test_sizes_signals_and_files(spark, tmp_path):
    w = planes.make_signal(spark, 5, 4).orderBy("r", "c").toPandas().w.to_numpy().reshape(5, 4)
    assert np.allclose(w, signal_array(5, 4))
    (tmp_path / "w.bin").write_bytes(w.astype("<f4").tobytes())
    back = planes.read_signal(spark, str(tmp_path / "w.bin"), 5, 4).orderBy("r", "c").toPandas()
    assert np.allclose(back.w.to_numpy().reshape(5, 4), w, atol=1e-6)
    with pytest.raises(Exception, match="size is wrong"):
        planes.read_signal(spark, str(tmp_path / "w.bin"), 5, 5).count()
    assert marking.size_mismatches(table(spark, smooth(5, 5)), planes.make_signal(spark, 5, 4)).count() == 1
    with pytest.raises(ValueError):
        neighbourhood.check(4, "zero")
    with pytest.raises(ValueError):
        pixel.target_rms(0)


def test_settings():
    s = Settings("[Parameters]\nP = 5 ; window\npsnr=38.5\nloops=0\n[video]\ninterval=0x10\nDetection=Yes\nbad line\n[paths]\nimage=a\nimage=b")
    o = options(s)
    assert (o.p, o.psnr, o.loops, o.interval, o.detection, o.image) == (5, 38.5, 5, 16, True, "a\nb")
    assert s.integer("video", "none", 7) == 7 and s.number("paths", "image", 1.5) == 1.5
    with pytest.raises(ValueError):
        Options(p=4)


def test_names_and_rates(spark):
    d = spark.createDataFrame([("a.b/c.png",)], "p string")
    assert d.select(pixel.with_suffix(F.col("p"), "_W").alias("x")).first().x == "a.b/c_W.png"
    with pytest.raises(Exception, match="no extension"):
        spark.createDataFrame([("ab.",)], "p string").select(pixel.with_suffix(F.col("p"), "_W")).collect()
    assert d.select(pixel.frame_rate(F.lit(30000.0), F.lit(1001.0)).alias("x")).first().x == 29.97


@pytest.mark.parametrize("n", [7, 501, 2000])
def test_rgb_plane_holds_every_whole_triple_of_vectors(spark, tmp_path, n):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(F.col("vec_id") < n)
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    v = np.floor(np.clip(x * 240 + 128, 0, 255))[: n // 3 * 3].reshape(n // 3, 3, 64)
    got = planes.rgb_plane(spark, str(tmp_path)).orderBy("r", "c").toPandas()
    assert len(got) == n // 3 * 64
    for ch, name in enumerate(("red", "green", "blue")):
        assert np.array_equal(got[name].to_numpy().reshape(n // 3, 64), v[:, ch])


@pytest.mark.parametrize("name", ["embed_me_gray", "embed_me_rgb", "embed_nvf_gray", "detect_me", "detect_nvf"])
def test_plans_have_few_scans_and_no_products(spark, name):
    from pixelveil.plans.queries import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("FileScan") <= 2, plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_signal_of_another_size_is_refused(spark):
    px = table(spark, smooth(5, 5))
    for run in (marking.embed, marking.detect):
        with pytest.raises(ValueError, match="5 x 5 pixels, the signal 5 x 4"):
            run(px, planes.make_signal(spark, 5, 4))
    with pytest.raises(ValueError, match="mask must be"):
        marking.detect(px, mask="other")


def test_a_large_frame_becomes_pixels(spark):
    y = np.arange(520 * 300, dtype=np.int64) % 251
    d = spark.createDataFrame([(1, 2, 300, 520, 300, bytearray(y.astype(np.uint8).tobytes()), bytearray(), bytearray())], video.FRAME)
    got = video.frames_to_pixels(d).orderBy("r", "c").toPandas()
    assert len(got) == 520 * 300 and np.array_equal(got.v, y) and set(got.frame_no) == {2}


def test_settings_lines_go_on_and_numbers_have_bases():
    s = Settings("\ufeff[paths]\nimage =\n  a.png\n  b.png\n[parameters]\np = 010\npsnr = 1e1\nloops_for_test = 0x2\n[parameters_video]\nwatermark_interval = 7\nencode_watermark_file_path = out.mp4\nwatermark_detection = on")
    assert s.text("paths", "image") == "a.png\nb.png" and s.integer("parameters", "p", 3) == 8
    o = options(Settings("[parameters]\np = 5\nloops_for_test = 4\n[parameters_video]\nwatermark_interval = 7\nencode_watermark_file_path = out.mp4\nwatermark_detection = on\n[paths]\nwatermark = w.dat"))
    assert (o.p, o.loops, o.interval, o.encode_to, o.detection, o.signal) == (5, 4, 7, "out.mp4", True, "w.dat")


def test_unsupported_formats_and_gray_files_are_refused(spark, tmp_path):
    from pixelveil.sources import sinks

    with pytest.raises(Exception, match="unsupported pixel format"):
        video.supported(spark.createDataFrame([("rgb24",)], "pixel_format string")).collect()
    rgb = spark.createDataFrame([(7, i, j, 10 * i, j, 200) for i in range(3) for j in range(2)], "img bigint, r bigint, c bigint, red bigint, green bigint, blue bigint")
    sinks.save_images(rgb, f"file://{tmp_path}", "W_NVF")
    assert [x.name for x in tmp_path.iterdir()] == ["7_W_NVF.png"]
    got = planes.read_images(spark, str(tmp_path)).orderBy("r", "c").collect()
    assert [(x.r, x.c, x.red, x.green, x.blue, x.alpha) for x in got] == [(i, j, 10 * i, j, 200, None) for i in range(3) for j in range(2)]


def test_numbering_a_long_stream(spark):
    rows = [(i % 2, (i * 7919) % 10_007) for i in range(3000)]
    got = video.numbered(spark.createDataFrame(rows, "stream_id int, at int").repartition(5), "at").collect()
    for stream in (0, 1):
        assert [r.frame_no for r in sorted((r for r in got if r.stream_id == stream), key=lambda r: r["at"])] == list(range(1500))
