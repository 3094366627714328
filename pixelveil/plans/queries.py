"""Queries over the test tables, one or more per operator, each with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelveil.functions import pixel
from pixelveil.functions.tables import new_path, stored
from pixelveil.operators import marking, neighbourhood, predictor, tiles
from pixelveil.plans.backends import ArrowBackend, Marker
from pixelveil.sources import planes, sinks
from pixelveil.sources.settings import as_flag, as_integer, read_settings
from pixelveil.streaming import frames as video

from . import oracles

Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _plane(s: SparkSession, d: str) -> DataFrame:
    return planes.embeddings_plane(s, d)


def _images(s: SparkSession, d: str) -> DataFrame:
    """Frames as images of their own: img = stream * 1000000 + frame."""
    return planes.frame_pixels(s, d).select((F.col("stream_id") * 1_000_000 + F.col("frame_no")).alias("img"), "r", "c", "v")


def _near_rows(s: SparkSession, d: str, p: int, border: str) -> DataFrame:
    near = neighbourhood.neighbours(_plane(s, d), p, border)
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col(x).alias("x")) for i, x in enumerate(neighbourhood.names(p))])
    return near.select("img", "r", "c", F.explode(cells).alias("n")).select("img", "r", "c", "n.k", "n.x")


def _gram(s: SparkSession, d: str, border: str) -> DataFrame:
    return predictor.gram_cells(predictor.gram(neighbourhood.neighbours(_plane(s, d), 3, border)))


def _coefficients(s: SparkSession, d: str, border: str = "zero") -> DataFrame:
    return predictor.coefficients(predictor.gram(neighbourhood.neighbours(_plane(s, d), 3, border)))


def _embedded(s: SparkSession, d: str, mask: str = "ME", border: str = "zero", quantize: bool = True) -> DataFrame:
    return tiles.embed(_plane(s, d), None, mask, 3, 40.0, border, quantize)


def _marked(s: SparkSession, d: str, mask: str, border: str = "zero") -> DataFrame:
    """The marked plane, stored, as it is scanned several times."""
    return stored(_embedded(s, d, mask, border).select("img", "r", "c", F.col("y").alias("v")), "marked")


def _frames(s: SparkSession, d: str) -> DataFrame:
    return video.pixels_to_frames(planes.frame_pixels(s, d))


def gray_from_rgb(s, d):
    return _round(planes.rgb_plane(s, d).select("img", "r", "c", pixel.gray(F.col("red"), F.col("green"), F.col("blue")).alias("v")), "v")


def alpha_zero(s, d):
    rgb = planes.rgb_plane(s, d)
    return rgb.select("img", "r", "c", *[pixel.visible(F.col(x), F.col("alpha")).alias(x) for x in ("red", "green", "blue")], "alpha")


def channel_pivot(s, d):
    return planes.to_wide(planes.to_long(planes.rgb_plane(s, d)))


def channel_unpivot(s, d):
    return planes.to_long(planes.rgb_plane(s, d))


def stride_compact(s, d):
    padded = _plane(s, d).select("img", (F.col("r") * 64 + F.col("c")).alias("pos"), "v", F.lit(64).alias("linesize"), F.lit(60).alias("width"))
    return planes.without_padding(padded)


def transpose(s, d):
    return planes.transposed(_plane(s, d))


def row_arrays(s, d):
    return planes.to_rows(_plane(s, d)).select("img", "r", F.size("px").cast("bigint").alias("n"), F.array_join("px", ",").alias("px"))


def text_planes(s, d):
    return planes.text_planes(s, d).groupBy("img").agg((F.max("r") + 1).alias("n_rows"), F.sum("v").cast("bigint").alias("total"), F.sum((F.col("r") * 64 + F.col("c") + 1) * F.col("v") % 9973).cast("bigint").alias("mixed"))


def event_frames(s, d):
    return planes.event_frames(s, d)


def _signal(s, d):
    """The signal of the vectors' plane."""
    return planes.make_signal(s, s.read.parquet(f"{d}/embeddings.parquet").count(), 64)


def signal_plane(s, d):
    return _round(_signal(s, d), "w")


def signal_size_check(s, d):
    return marking.size_mismatches(_images(s, d), planes.make_signal(s, 8, 9))


def dense_check(s, d):
    return neighbourhood.sparse_images(_images(s, d).where("not (r = 3 and c = 3 and img % 5 = 0)"))


def _cell_sums(near: DataFrame, p: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col(x).alias("x")) for i, x in enumerate(neighbourhood.names(p))])
    rows = near.select("img", "r", "c", F.explode(cells).alias("n"))
    return rows.groupBy("img", "n.k").agg(F.sum("n.x").cast("bigint").alias("total"), F.sum((F.col("r") * 64 + F.col("c")) % 9973 * F.col("n.x")).cast("bigint").alias("mixed"))


def _near_sums(p: int, border: str) -> Query:
    return lambda s, d: _cell_sums(neighbourhood.neighbours(_plane(s, d), p, border), p)


def _embedding(mask, p: int, border: str = "zero") -> Query:
    return lambda s, d: marking.embed(_plane(s, d), None, mask, p, 40.0, border).select("img", "r", "c", "y")


def nvf_mask_p7_edge(s, d):
    return _round(neighbourhood.nvf_mask(_plane(s, d), 7, "edge"), "m")


def detect_me_p5(s, d):
    """By windows throughout."""
    marked = stored(_embedding("ME", 5)(s, d).withColumnRenamed("y", "v"), "marked")
    return _round(marking.detect(marked, None, "ME", 5), "correlation")


def detect_nvf_edge(s, d):
    return _detect(s, d, "NVF", "edge")


def embed_nvf_rgb(s, d):
    return marking.embed_rgb(planes.rgb_plane(s, d), mask="NVF").select("img", "r", "c", "red", "green", "blue", "alpha")


def _other_signal(s, d):
    """A signal of the plane's size, as a stored table."""
    signal = planes.make_signal(s, s.read.parquet(f"{d}/embeddings.parquet").count(), 64, 7)
    path = new_path(s, "signal")
    sinks.write_signal(signal, path)
    return s.read.parquet(path)


def embed_stored_signal(s, d):
    return marking.embed(_plane(s, d), _other_signal(s, d)).select("img", "r", "c", "y")


def detect_stored_signal(s, d):
    signal = _other_signal(s, d)
    marked = stored(marking.embed(_plane(s, d), signal, "NVF").select("img", "r", "c", F.col("y").alias("v")), "marked")
    return _round(marking.detect(marked, signal, "NVF"), "correlation")


def signal_file(s, d):
    path, signal = new_path(s, "signal"), stored(_signal(s, d), "signal")
    sinks.write_signal_file(signal, path)
    return _round(planes.read_signal(s, path, signal.select("r").distinct().count(), 64), "w")


def signal_table(s, d):
    path = new_path(s, "signal")
    sinks.write_signal(_signal(s, d), path)
    return _round(s.read.parquet(path), "w")


def _colour_frames(s, d):
    """An 8 x 8 image of every three vectors, with alpha 0 at every seventh pixel."""
    rgb = planes.rgb_plane(s, d)
    return rgb.select(F.col("r").alias("img"), F.floor(F.col("c") / 8).alias("r"), (F.col("c") % 8).alias("c"), "red", "green", "blue", "alpha")


def image_files_bmp(s, d):
    path = new_path(s, "images")
    sinks.save_images(_colour_frames(s, d).drop("alpha"), path, "W_NVF", "bmp")
    return planes.read_images(s, path).select(F.regexp_extract("path", r"(\d+)_W_NVF\.bmp$", 1).cast("bigint").alias("img"), "r", "c", "red", "green", "blue", "alpha")


def marker_embeds(s, d):
    """A signal written to segments and read back by the one that marks with it."""
    path, signal = new_path(s, "signal"), stored(_signal(s, d), "signal")
    sinks.write_signal_file(signal, path)
    marker = Marker.create(s, signal.select("r").distinct().count(), 64, path, 5)
    return marker.embed(_plane(s, d)).select("img", "r", "c", "y")


def image_files(s, d):
    path = new_path(s, "images")
    sinks.save_images(_colour_frames(s, d), path, "W_ME")
    return planes.read_images(s, path).select(F.regexp_extract("path", r"(\d+)_W_ME\.png$", 1).cast("bigint").alias("img"), "r", "c", "red", "green", "blue", "alpha")


def _level(px: DataFrame, p: int, border: str) -> DataFrame:
    """A mask of our own: the pixel's level."""
    return px.select("img", "r", "c", (F.col("v") / 255.0).alias("m"))


def embed_custom_mask(s, d):
    return _embedding(_level, 3)(s, d)


def detect_custom_mask(s, d):
    marked = stored(_embedding(_level, 3)(s, d).withColumnRenamed("y", "v"), "marked")
    return _round(marking.detect(marked, None, _level), "correlation")


def _flat(s, d):
    """An 8 x 8 plane of one level per vector."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("img"), (F.col("label") * 7).cast("bigint").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return e.select("img", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).cast("bigint").alias("c"), "v")


def flat_planes_embed(s, d):
    return marking.embed(_flat(s, d), border="edge")


def flat_planes_detect(s, d):
    return marking.detect(_flat(s, d), border="edge")


def _strided(s, d):
    """Frames whose lines have four bytes of padding, with chroma planes of the frame's first bytes."""

    def pad(batches):
        for b in batches:
            b["u"], b["v"] = [y[:16] for y in b["y"]], [y[16:32] for y in b["y"]]
            b["y"] = [b"".join(y[i : i + 8] + b"\xff" * 4 for i in range(0, 64, 8)) for y in b["y"]]
            yield b.assign(linesize=12)

    return _frames(s, d).mapInPandas(pad, video.FRAME)


def strided_frames(s, d):
    return video.frames_to_pixels(_strided(s, d))


def strided_chroma(s, d):
    f = video.embed_stream(video.compacted(_strided(s, d)), 10)
    return f.select("stream_id", "frame_no", "linesize", F.length("y").cast("bigint").alias("y_bytes"), F.hex("u").alias("u"), F.hex("v").alias("v"))


def chroma_passes(s, d):
    return video.embed_stream(_strided(s, d), 10).select("stream_id", "frame_no", "width", F.hex("u").alias("u"), F.hex("v").alias("v"))


def pixel_formats(s, d):
    f = planes.frame_pixels(s, d).select("stream_id", "frame_no").distinct().withColumn("pixel_format", F.when(F.col("frame_no") % 2 == 0, "yuv420p").otherwise("yuvj420p"))
    return video.supported(f)


def process_embeds(s, d):
    return video.frames_to_pixels(video.process_stream(_frames(s, d), True, True, interval=10))


def process_detects(s, d):
    return _round(video.process_stream(_frames(s, d), False, True, interval=10), "correlation")


def _streamed(s, d, what):
    """What a stream that reads stored frames and ends has written."""
    source, out, state = new_path(s, "frames"), new_path(s, "out"), new_path(s, "state")
    sinks.write_frames(_frames(s, d), source)
    stream = what(video.read_stream(s, f"{source}/batch=0"))
    video.write_stream(stream, out, state).awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def streamed_embed(s, d):
    return video.frames_to_pixels(_streamed(s, d, lambda f: video.embed_stream(f, 10)))


def streamed_detect(s, d):
    return _round(_streamed(s, d, lambda f: video.detect_stream(f, 10)), "correlation")


def report_scores(s, d):
    px = _images(s, d)
    strengths = marking.strengthened(px, None, "ME", 3, 40.0, "zero").groupBy("img").agg(F.max("strength").alias("strength"))
    out = sinks.report(marking.detect(px), "ME", 3, 40.0, strengths, 1.5, 2)
    return _round(out.select("img", "mask", "p", "psnr", "strength", "correlation", "seconds", "time"), "strength", "correlation")


def duration_texts(s, d):
    """Odd numerators, as engines round exact halves differently."""
    seconds = (F.col("o_orderkey") % 488 * 2 + 1) / F.lit(1009.0)
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", pixel.duration_text(seconds, False).alias("seconds"), pixel.duration_text(seconds, True).alias("rate"))


def settings_values(s, d):
    """A settings text per region with a section and keys per nation, read back; every tenth number has a digit that its base lacks."""
    n = F.col("n_nationkey")
    number = F.when(n % 3 > 0, F.concat(F.lit("0x"), F.lower(F.hex(n)))).when(n % 2 > 0, F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8), F.lit("9"))).otherwise(n.cast("string"))
    lines = F.concat_ws("\n", F.format_string("[%s] of a region", "n_name"), F.concat(F.lit("Number = "), number, F.lit(" ; a # nation")), F.concat(F.lit("real: "), (n / 8).cast("string")), F.concat(F.lit("Flag = "), F.when(n % 2 == 0, "Yes").otherwise("off")), F.concat(F.lit("name = a #"), n.cast("string"), F.lit(".png\n\t"), F.col("n_name")))
    texts = s.read.parquet(f"{d}/nation.parquet").groupBy(F.col("n_regionkey").cast("string").alias("source")).agg(F.concat_ws("\n", F.array_sort(F.collect_list(lines))).alias("text"))
    got = read_settings(texts).groupBy("source", "section").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("number", "real", "flag", "name")])
    return got.select("source", "section", as_integer(F.col("number")).alias("number"), F.col("real").cast("double").alias("real"), as_flag(F.col("flag")).alias("flag"), F.col("name"))


def _tiled_sums(p: int, border: str) -> Query:
    return lambda s, d: _cell_sums(tiles.neighbours(_plane(s, d), p, border), p)


def _tiled_moments(border: str) -> Query:
    return lambda s, d: tiles.moments(_plane(s, d), border=border)


def _tiled_gram(p: int, border: str) -> Query:
    def q(s, d):
        cells = predictor.gram_cells(tiles.gram(tiles.tiled(_plane(s, d), p // 2), p, border), p)
        return cells.select("img", "i", "j", F.col("g").cast("bigint").alias("g"))

    return q


def _tiled_embed(mask: str, p: int, border: str = "zero") -> Query:
    return lambda s, d: tiles.embed(_plane(s, d), None, mask, p, 40.0, border).select("img", "r", "c", "y")


def _tiled_detect(mask: str, p: int, border: str = "zero") -> Query:
    def q(s, d):
        marked = stored(_tiled_embed(mask, p, border)(s, d).withColumnRenamed("y", "v"), "marked")
        return _round(tiles.detect(marked, None, mask, p, border), "correlation")

    return q


def _window_embed(mask: str, border: str = "zero") -> Query:
    return lambda s, d: marking.embed(_plane(s, d), None, mask, 3, 40.0, border).select("img", "r", "c", "y")


def _window_detect(mask: str, border: str = "zero") -> Query:
    def q(s, d):
        marked = stored(_window_embed(mask, border)(s, d).withColumnRenamed("y", "v"), "marked")
        return _round(marking.detect(marked, None, mask, 3, border), "correlation")

    return q


def window_embed_me_rgb(s, d):
    return marking.embed_rgb(planes.rgb_plane(s, d)).select("img", "r", "c", "red", "green", "blue", "alpha")


def tiled_embed_frames(s, d):
    return tiles.embed(_images(s, d)).select("img", "r", "c", "y")


def tiled_detect_frames(s, d):
    return _round(tiles.detect(_images(s, d)), "correlation")


def tiled_stored_signal(s, d):
    return tiles.embed(_plane(s, d), _other_signal(s, d)).select("img", "r", "c", "y")


def _sparse_neighbours(border: str) -> Query:
    def q(s, d):
        near = neighbourhood.neighbours_of_any(_images(s, d).where("not (r = 3 and c = 3 and img % 5 = 0)"), 3, border)
        cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col(x).alias("x")) for i, x in enumerate(neighbourhood.names(3))])
        return near.select("img", "r", "c", F.explode(cells).alias("n")).select("img", "r", "c", "n.k", "n.x")

    return q


def _coefficients_in_sql(border: str) -> Query:
    def q(s, d):
        packed = predictor.gram(neighbourhood.neighbours(_images(s, d), 3, border))
        return _round(predictor.coefficients_in_sql(packed).select("img", F.posexplode("k").alias("i", "k")), "k")

    return q


def strided_marked(s, d):
    """Marked luma with the padding of its lines, and as it is written, without."""
    f = video.embed_stream(_strided(s, d), 10)
    plain = video.compacted(f).select("stream_id", "frame_no", F.hex("y").alias("written"))
    return f.select("stream_id", "frame_no", F.hex("y").alias("padded")).join(plain, ["stream_id", "frame_no"])


def streamed_numbers(s, d):
    """Two runs of one stream: the first sees the lower half of the vectors, the second goes on with the upper half."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("bigint").alias("stream_id"), "vec_id")
    source, out, state = new_path(s, "packets"), new_path(s, "out"), new_path(s, "state")
    middle = e.agg(F.percentile_approx("vec_id", 0.5)).first()[0]
    for half in (F.col("vec_id") <= F.lit(middle), F.col("vec_id") > F.lit(middle)):
        e.where(half).write.mode("append").parquet(source)
        stream = video.numbered_stream(s.readStream.schema(e.schema).parquet(source), "vec_id")
        video.write_stream(stream, out, state).awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def _packets(s, d):
    """Packets of the events, and those of sources with a video stream."""
    kind = F.when((F.col("event_id") % 4).isin(1, 2), "video").otherwise("audio")
    p = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("source"), (F.col("event_id") % 4).alias("stream_index"), kind.alias("type"), "event_id", (F.col("event_id") % 5 != 0).alias("accepted"))
    with_video = p.groupBy("source").agg(F.max((F.col("type") == "video").cast("int")).alias("k")).where("k = 1").select("source")
    return p, p.join(with_video, "source", "left_semi")


def packet_filter(s, d):
    p, streams = _packets(s, d)
    return video.video_packets(p, streams).select("source", "stream_index", "event_id")


def streamed_packets(s, d):
    p, streams = _packets(s, d)
    source, out, state = new_path(s, "packets"), new_path(s, "out"), new_path(s, "state")
    p.write.parquet(source)
    stream = video.video_packets(s.readStream.schema(p.schema).parquet(source), streams).select("source", "stream_index", "event_id")
    video.write_stream(stream, out, state).awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def video_segments(s, d):
    """Raw marked frames as files, 16 a segment, by stream and place in its bytes."""
    path = new_path(s, "video")
    sinks.write_video(video.embed_stream(_frames(s, d), 10), path, 16)
    files = s.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    content = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).cast("bigint").alias("stream_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return sinks.segment_offsets(s, path).join(content, ["stream_id", "name"])


def report_run(s, d):
    """A report whose count and time come from the run; the time itself, which differs, is only compared with zero."""
    scores, frames, seconds = sinks.timed(video.detect_stream(_frames(s, d), 10).select((F.col("stream_id") * 1_000_000 + F.col("frame")).alias("img"), "correlation"), new_path(s, "scores"))
    out = sinks.report(scores, "ME", 3, 40.0, seconds=seconds, frames=frames).withColumn("frames", F.lit(frames).cast("bigint"))
    return _round(out.select("img", "mask", "p", "psnr", "correlation", "frames", (F.col("seconds") > 0).alias("timed")), "correlation")


def _moments(p: int, border: str) -> Query:
    def q(s, d):
        return neighbourhood.moments(_plane(s, d), p, border).select("img", "r", "c", F.col("total").cast("bigint"), F.col("squares").cast("bigint"))

    return q


def nvf_mask_zero(s, d):
    return _round(neighbourhood.nvf_mask(_plane(s, d), 3, "zero"), "m")


def nvf_mask_edge(s, d):
    return _round(neighbourhood.nvf_mask(_plane(s, d), 3, "edge"), "m")


def nvf_mask_p9_edge(s, d):
    return _round(neighbourhood.nvf_mask(_plane(s, d), 9, "edge"), "m")


def predictor_coefficients(s, d):
    return _round(_coefficients(s, d).select("img", F.posexplode("k").alias("i", "k")), "k")


def predictor_coefficients_edge(s, d):
    return _round(_coefficients(s, d, "edge").select("img", F.posexplode("k").alias("i", "k")), "k")


def residual(s, d):
    near = neighbourhood.neighbours(_plane(s, d), 3, "zero")
    return _round(predictor.residual(near, predictor.coefficients(predictor.gram(near))).select("img", "r", "c", "e"), "e")


def me_mask(s, d):
    return _round(predictor.me_mask(_plane(s, d)).select("img", "r", "c", "m"), "m")


def me_mask_edge(s, d):
    return _round(predictor.me_mask(_plane(s, d), 3, "edge").select("img", "r", "c", "m"), "m")


def embed_nvf_gray(s, d):
    return _embedded(s, d, "NVF").select("img", "r", "c", "y")


def embed_me_gray(s, d):
    return _embedded(s, d).select("img", "r", "c", "y")


def embed_me_gray_edge(s, d):
    return _embedded(s, d, border="edge").select("img", "r", "c", "y")


def embed_me_rgb(s, d):
    return tiles.embed_rgb(planes.rgb_plane(s, d)).select("img", "r", "c", "red", "green", "blue", "alpha")


def strength(s, d):
    return _round(_embedded(s, d).groupBy("img").agg(F.max("strength").alias("strength")), "strength")


def psnr_check(s, d):
    px = _plane(s, d)
    u = marking.strengthened(px, None, "ME", 3, 40.0, "zero")
    change = u.select("img", "r", "c", "v", (F.col("strength") * F.col("u")).alias("d"))
    return _round(change.groupBy("img").agg((F.log10(F.lit(65025.0) / F.avg(F.col("d") * F.col("d"))) * 10.0).alias("psnr")), "psnr")


def _detect(s, d, mask: str, border: str = "zero"):
    return _round(tiles.detect(_marked(s, d, mask, border), None, mask, 3, border), "correlation")


def detect_nvf(s, d):
    return _detect(s, d, "NVF")


def detect_me(s, d):
    return _detect(s, d, "ME")


def detect_me_edge(s, d):
    return _detect(s, d, "ME", "edge")


def detect_unmarked(s, d):
    return _round(marking.detect(_plane(s, d), None, "ME"), "correlation")


def arrow_embed(s, d):
    return ArrowBackend.embed(_images(s, d), mask="ME").select("img", "r", "c", "y")


def arrow_detect(s, d):
    return _round(ArrowBackend.detect(_images(s, d), mask="ME"), "correlation")


def relational_detect_frames(s, d):
    return _round(marking.detect(_images(s, d), None, "ME"), "correlation")


def frame_sample(s, d):
    return planes.frame_pixels(s, d).where("frame_no % 30 = 0")


def frame_embed_interval(s, d):
    return video.frames_to_pixels(video.embed_stream(_frames(s, d), 10))


def frame_detect_interval(s, d):
    return _round(video.detect_stream(_frames(s, d), 10), "correlation")


def frame_count(s, d):
    return video.frame_counts(planes.frame_pixels(s, d).select("stream_id", "frame_no").distinct())


def frame_numbers(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("bigint").alias("stream_id"), "vec_id")
    return video.numbered(e, "vec_id")


def first_video_stream(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("source"), F.when(F.col("event_id") % 3 == 0, "audio").otherwise("video").alias("type"), F.col("event_id").alias("stream_index"))
    has = e.groupBy("source").agg(F.max((F.col("type") == "video").cast("int")).alias("k")).where("k = 1").select("source")
    return planes.first_video(e.join(has, "source"))


def output_suffix(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("out.d/img"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".png").otherwise(".tar.JPG")).alias("path"))
    return p.select("path", pixel.with_suffix(F.col("path"), "_W_ME").alias("marked"))


def frame_rate(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 7 * 1000 + 30).alias("num"), (F.col("o_orderkey") % 5 * 125).alias("den"))
    return o.select("o_orderkey", pixel.frame_rate(F.col("num").cast("double"), F.col("den").cast("double")).alias("rate"))


def queries() -> dict[str, Query]:
    plain = [gray_from_rgb, alpha_zero, channel_pivot, channel_unpivot, stride_compact, transpose, row_arrays, text_planes, event_frames, signal_plane, signal_size_check, dense_check, nvf_mask_zero, nvf_mask_edge, nvf_mask_p9_edge, predictor_coefficients, predictor_coefficients_edge, residual, me_mask, me_mask_edge, embed_nvf_gray, embed_me_gray, embed_me_gray_edge, embed_me_rgb, strength, psnr_check, detect_nvf, detect_me, detect_me_edge, detect_unmarked, arrow_embed, arrow_detect, relational_detect_frames, frame_sample, frame_embed_interval, frame_detect_interval, frame_count, frame_numbers, first_video_stream, output_suffix, frame_rate]
    plain += [nvf_mask_p7_edge, detect_me_p5, detect_nvf_edge, embed_nvf_rgb, embed_stored_signal, detect_stored_signal, signal_file, signal_table, image_files, embed_custom_mask, detect_custom_mask, flat_planes_embed, flat_planes_detect, strided_frames, strided_chroma, chroma_passes, pixel_formats, process_embeds, process_detects, streamed_embed, streamed_detect, packet_filter, report_scores, duration_texts, settings_values]
    plain += [tiled_embed_frames, tiled_detect_frames, tiled_stored_signal, strided_marked, streamed_numbers, streamed_packets, video_segments, report_run, image_files_bmp, marker_embeds, window_embed_me_rgb]
    out: dict[str, Query] = {f.__name__: f for f in plain}
    for border in ("zero", "edge"):
        out |= {f"tiled_moments_{border}": _tiled_moments(border), f"sparse_neighbours_{border}": _sparse_neighbours(border), f"coefficients_in_sql_{border}": _coefficients_in_sql(border)}
    for p, border in ((3, "zero"), (5, "edge"), (9, "zero"), (9, "edge")):
        out[f"tiled_sums_p{p}_{border}"] = _tiled_sums(p, border)
    out |= {"tiled_gram_p3_edge": _tiled_gram(3, "edge"), "tiled_gram_p7": _tiled_gram(7, "zero"), "tiled_gram_p9": _tiled_gram(9, "zero")}
    out |= {"embed_me_p7": _tiled_embed("ME", 7), "embed_me_p9": _tiled_embed("ME", 9), "tiled_embed_nvf_p9_edge": _tiled_embed("NVF", 9, "edge")}
    out |= {"window_embed_me": _window_embed("ME"), "window_embed_me_edge": _window_embed("ME", "edge"), "window_embed_nvf": _window_embed("NVF")}
    out |= {"window_detect_me": _window_detect("ME"), "window_detect_me_edge": _window_detect("ME", "edge"), "window_detect_nvf": _window_detect("NVF")}
    out |= {"detect_me_p7": _tiled_detect("ME", 7), "detect_me_p9": _tiled_detect("ME", 9)}
    for p in (3, 5, 7, 9):
        out[f"window_moments_p{p}"] = _moments(p, "zero")
    out["window_moments_p5_edge"] = _moments(5, "edge")
    for border in ("zero", "edge"):
        out[f"neighbours_p3_{border}"] = lambda s, d, b=border: _near_rows(s, d, 3, b)
        out[f"gram_{border}"] = lambda s, d, b=border: _gram(s, d, b)
    for name, mask, p, border in (("embed_nvf_p5", "NVF", 5, "zero"), ("embed_nvf_p7_edge", "NVF", 7, "edge"), ("embed_nvf_p9", "NVF", 9, "zero"), ("embed_me_p5", "ME", 5, "zero"), ("embed_me_p5_edge", "ME", 5, "edge")):
        out[name] = _embedding(mask, p, border)
    for p, border in ((5, "zero"), (7, "edge"), (9, "zero"), (9, "edge")):
        out[f"neighbour_sums_p{p}_{border}"] = _near_sums(p, border)
    out["neighbours_p5_edge"] = lambda s, d: _near_rows(s, d, 5, "edge")
    return out


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
