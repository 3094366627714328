"""Where results go: Parquet tables of pixels, signals, frames and reports, and files of images, signals and video."""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.listener import StreamingQueryListener

from pixelveil.functions.pixel import duration_text
from pixelveil.functions.tables import with_import_path

from .files import write_files


def write_image(rgb: DataFrame, path: str) -> None:
    """Marked pixels, alpha kept, one folder per image; rows of an image stay in order within files."""
    out = rgb.repartitionByRange("img", "r").sortWithinPartitions("img", "r", "c")
    out.write.mode("overwrite").partitionBy("img").parquet(path)


def png(plane: np.ndarray) -> bytes:
    """A PNG file of rows x columns x 3 or 4 bytes."""
    h, w, n = plane.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), plane.reshape(h, w * n)], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def bmp(plane: np.ndarray) -> bytes:
    """A BMP file of rows x columns x 3 or 4 bytes: 24 or 32 bits a pixel, blue first, the last row first, rows of whole four bytes."""
    h, w, n = plane.shape
    turned = plane[::-1, :, [2, 1, 0, 3][:n]].reshape(h, w * n)
    lines = np.pad(turned, ((0, 0), (0, -(w * n) % 4))).tobytes()
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * n, 0, len(lines), 0, 0, 0, 0)
    return struct.pack("<2sIHHI", b"BM", 54 + len(lines), 0, 0, 54) + head + lines


#: What makes a file's bytes, by extension.
ENCODERS = {"png": png, "bmp": bmp}


def encoded_images(rgb: DataFrame, extension: str = "png") -> DataFrame:
    """``(img, content)``: each image, with alpha if there is one, as a file of a kind of ``ENCODERS``; an image must fit a task, as any file's does."""
    if extension.lower() not in ENCODERS:
        raise ValueError(f"images can be written as {', '.join(ENCODERS)}, not as {extension}")
    encode = ENCODERS[extension.lower()]
    names = ["red", "green", "blue", *(["alpha"] if "alpha" in rgb.columns else [])]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((int(d.r.max()) + 1, int(d.c.max()) + 1, len(names)), np.uint8)
        plane[d.r, d.c] = d[names].to_numpy()
        return pd.DataFrame({"img": d.img[:1], "content": [encode(plane)]})

    with_import_path(rgb.sparkSession)
    return rgb.select("img", "r", "c", *names).groupBy("img").applyInPandas(run, "img bigint, content binary")


def save_images(rgb: DataFrame, path: str, suffix: str = "", extension: str = "png") -> None:
    """One file per image under ``path``, named by image and ``suffix`` (W_ME, W_NVF), written by tasks; images of the same names are replaced."""
    name = F.concat(F.col("img").cast("string"), F.lit(f"{'_' * bool(suffix)}{suffix}.{extension}"))
    write_files(encoded_images(rgb, extension).select(name.alias("name"), "content"), path)


def write_signal(signal: DataFrame, path: str) -> None:
    signal.repartitionByRange("r", "c").sortWithinPartitions("r", "c").write.mode("overwrite").parquet(path)


#: Bytes of a signal's segment, and frames of a segment of video.
SEGMENT_BYTES, SEGMENT_FRAMES = 16 << 20, 32


def _joined(rows: DataFrame, keys: list[str], value: str, turn: Callable[[pa.Array], bytes]) -> DataFrame:
    """``(*keys, content)``: the values of sorted rows, turned to bytes and joined, for each run of equal keys (longs)."""
    schema = T.StructType([T.StructField(k, T.LongType()) for k in keys] + [T.StructField("content", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def put(key: tuple, parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, b"".join(parts)), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            k = np.stack([b.column(i).to_numpy() for i in range(len(keys))], 1)
            cuts = [0, *(np.flatnonzero((np.diff(k, axis=0) != 0).any(1)) + 1).tolist(), len(k)] if len(k) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if now is not None and now != tuple(k[a].tolist()):
                    yield put(now, parts)
                    parts = []
                now = tuple(k[a].tolist())
                parts.append(turn(b.column(len(keys))[a:z]))
        if now is not None:
            yield put(now, parts)

    with_import_path(rows.sparkSession)
    return rows.select(*keys, value).mapInArrow(run, schema)


def write_signal_file(signal: DataFrame, path: str) -> None:
    """The signal as row-major 32-bit floats under ``path``: segments of whole lines, each named by its first line, written by tasks.

    The segments in order of name are the file; ``read_signal`` reads them, or the file they make. Fails for a signal with holes.
    """
    rows, cols, n = signal.agg(F.max("r") + 1, F.max("c") + 1, F.count("*")).first()
    if n != (rows or 0) * (cols or 0):
        raise ValueError(f"the signal has {n} of {rows} x {cols} values")
    if not n:
        return
    lines = max(1, SEGMENT_BYTES // (4 * cols))
    dealt = signal.select((F.floor(F.col("r") / lines) * lines).alias("first"), F.col("r"), F.col("c"), F.col("w").cast("float").alias("w"))
    dealt = dealt.repartition("first").sortWithinPartitions("first", "r", "c")
    parts = _joined(dealt, ["first"], "w", lambda x: x.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
    write_files(parts.select(F.format_string("%012d.f32", "first").alias("name"), "content"), path)


def frame_segments(frames: DataFrame, frames_a_segment: int = SEGMENT_FRAMES) -> DataFrame:
    """``(stream_id, first, content)``: raw planes Y, U, V of frames in order, ``frames_a_segment`` numbers a segment, which begins at number ``first``."""
    rows = frames.select("stream_id", (F.floor(F.col("frame_no") / frames_a_segment) * frames_a_segment).alias("first"), "frame_no", F.concat("y", "u", "v").alias("planes"))
    rows = rows.repartition("stream_id", "first").sortWithinPartitions("stream_id", "first", "frame_no")
    return _joined(rows, ["stream_id", "first"], "planes", lambda x: b"".join(x.to_pylist()))


def write_video(frames: DataFrame, path: str, frames_a_segment: int = SEGMENT_FRAMES):
    """Raw frames for an encoder: a folder per stream whose segments, in order of name, are its input.

    A streaming table gives a writer, not yet started, whose micro-batches write segments of their own, named by their first frame
    and by batch; a batch that is run again replaces them by the same bytes.
    """

    def body(batch: DataFrame, number: int | None) -> None:
        own = "" if number is None else f"-{number:09d}"
        name = F.format_string("%d/%012d%s.yuv", "stream_id", "first", F.lit(own))
        write_files(frame_segments(batch, frames_a_segment).select(name.alias("name"), "content"), path)

    return frames.writeStream.foreachBatch(body) if frames.isStreaming else body(frames, None)


def segment_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``(stream_id, name, position, length)``: where each segment under ``path`` begins in its stream's bytes, from the lengths before it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).cast("bigint").alias("stream_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    before = Window.partitionBy("stream_id").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return at.select("stream_id", "name", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("position"), "length")


def write_frames(frames: DataFrame, path: str):
    """The body of a ``foreachBatch``: frames in order within each stream, one folder per batch, so a batch that is run again replaces itself."""

    def body(batch: DataFrame, number: int) -> None:
        batch.repartitionByRange("stream_id", "frame_no").sortWithinPartitions("stream_id", "frame_no").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return body(frames, 0) if not frames.isStreaming else frames.writeStream.foreachBatch(body)


def report(scores: DataFrame, mask: str, p: int, psnr: float, strengths: DataFrame | None = None, seconds: float | None = None, frames: int | None = None) -> DataFrame:
    """``(img, mask, p, psnr, strength, correlation, text, seconds, time)``: scores with 16 digits' text.

    ``strengths`` are (img, strength). ``seconds`` of the whole run, and its average for each of ``frames``, as text.
    """
    s = scores.join(strengths.select("img", "strength"), "img", "left") if strengths is not None else scores.withColumn("strength", F.lit(None).cast("double"))
    took = F.lit(seconds).cast("double")
    return s.select("img", F.lit(mask).alias("mask"), F.lit(p).alias("p"), F.lit(float(psnr)).alias("psnr"), "strength", "correlation", F.format_string("%.16f", "correlation").alias("text"), took.alias("seconds"), duration_text(took / F.lit(frames or 1), False).alias("time"))


def timed(df: DataFrame, path: str, what: str = "frames") -> tuple[DataFrame, int, float]:
    """``df`` written to ``path`` and read from there, its rows, counted while they are written, and the seconds that took."""
    seen = Observation(what)
    began = time.perf_counter()
    df.observe(seen, F.count("*").alias("n")).write.parquet(path)
    took = time.perf_counter() - began
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get["n"]), took


class RunTimes(StreamingQueryListener):
    """Rows and seconds of a session's streaming queries, by their ids, while it is added to ``spark.streams``."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.seconds: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)
        self.seconds.setdefault(str(event.id), 0.0)

    def onQueryProgress(self, event) -> None:
        k = str(event.progress.id)
        self.rows[k] = self.rows.get(k, 0) + event.progress.numInputRows
        self.seconds[k] = self.seconds.get(k, 0.0) + event.progress.batchDuration / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
