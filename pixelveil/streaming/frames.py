"""Frame streams: every k-th frame of a stream is marked or tested, on batches and on streaming tables alike.

A frame row is ``(stream_id, frame_no, width, height, linesize, y, u, v)`` with binary planes. Frames are independent, so
no state is kept and any number of them is handled side by side. Only luma is marked; chroma passes unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pixelveil.functions.runs import whole_runs
from pixelveil.functions.tables import with_import_path
from pixelveil.plans.backends import detect_plane, embed_plane
from pixelveil.sources.planes import first_video, numbered  # noqa: F401  numbers are a frame's, too

FRAME = "stream_id bigint, frame_no bigint, width int, height int, linesize int, y binary, u binary, v binary"
FORMATS = ("yuv420p", "yuvj420p")


def _interval(interval: int) -> int:
    if interval < 1:
        raise ValueError("the interval must be positive")
    return interval


def luma(y: bytes, width: int, height: int, linesize: int) -> np.ndarray:
    """A plane without the padding of its lines."""
    return np.frombuffer(y, np.uint8)[: linesize * height].reshape(height, linesize)[:, :width]


def compacted(frames: DataFrame) -> DataFrame:
    """Frames whose planes have no line padding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d["y"] = [luma(r.y, r.width, r.height, r.linesize).tobytes() for r in d.itertuples()]
            for c in "uv":
                half = lambda n: -(-n // 2)
                d[c] = [x if len(x) == half(r.width) * half(r.height) else luma(x, half(r.width), half(r.height), len(x) // max(1, half(r.height))).tobytes() for x, r in zip(d[c], d.itertuples(), strict=True)]
            d["linesize"] = d["width"]
            yield d

    with_import_path(frames.sparkSession)
    return frames.select("stream_id", "frame_no", "width", "height", "linesize", "y", "u", "v").mapInPandas(run, FRAME)


def supported(frames: DataFrame, pixel_format: str = "pixel_format") -> DataFrame:
    """The frames; fails on one of another pixel format than planar 4:2:0."""
    ok = F.assert_true(F.col(pixel_format).isin(*FORMATS), F.concat(F.lit("unsupported pixel format "), F.col(pixel_format)))
    return frames.where(ok.isNull())


def embed_stream(frames: DataFrame, interval: int = 30, p: int = 3, psnr: float = 40.0, border: str = "zero") -> DataFrame:
    """Frames with marked luma where frame_no is a multiple of ``interval``; all others pass byte by byte."""
    every = _interval(interval)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for r in d.itertuples():
                if r.frame_no % every:
                    out.append(r.y)
                else:
                    marked, _ = embed_plane(luma(r.y, r.width, r.height, r.linesize), mask="ME", p=p, psnr=psnr, border=border)
                    whole = np.frombuffer(r.y, np.uint8)[: r.linesize * r.height].reshape(r.height, r.linesize).copy()
                    whole[:, : r.width] = np.floor(marked)
                    out.append(whole.tobytes() + bytes(r.y[r.linesize * r.height :]))
            yield d.assign(y=out)

    with_import_path(frames.sparkSession)
    return frames.select("stream_id", "frame_no", "width", "height", "linesize", "y", "u", "v").mapInPandas(run, FRAME)


def detect_stream(frames: DataFrame, interval: int = 30, p: int = 3, border: str = "zero") -> DataFrame:
    """``(stream_id, frame, correlation)`` of every ``interval``-th frame, frames counted from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            score = [detect_plane(luma(r.y, r.width, r.height, r.linesize), p=p, border=border) for r in d.itertuples()]
            yield pd.DataFrame({"stream_id": d.stream_id, "frame": d.frame_no + 1, "correlation": score})

    with_import_path(frames.sparkSession)
    wanted = frames.where(F.col("frame_no") % _interval(interval) == 0)
    return wanted.select("stream_id", "frame_no", "width", "height", "linesize", "y").mapInPandas(run, "stream_id bigint, frame bigint, correlation double")


def process_stream(frames: DataFrame, encode: bool, detect: bool, **options) -> DataFrame | None:
    """Embeds if ``encode``, else detects if ``detect``, else does nothing."""
    return embed_stream(frames, **options) if encode else detect_stream(frames, **options) if detect else None


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stream_id").agg(F.count("*").alias("frames"))


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of frame rows from Parquet files."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_stream(frames: DataFrame, path: str, checkpoint: str):
    """Write what is there and end, with exactly-once files; the query, not yet awaited."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def video_packets(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets ``(source, stream_index, accepted, ...)`` of each source's first video stream that the decoder accepted.

    ``packets`` may be a stream; it meets the table of ``streams`` batch by batch, and what is there when it ends is put out.
    """
    return packets.where("accepted").join(first_video(streams), ["source", "stream_index"], "left_semi")


def pixels_to_frames(px: DataFrame) -> DataFrame:
    """Frame rows from ``(stream_id, frame_no, r, c, v)``; chroma is neutral. Fails for frames with holes or repeated places.

    Pixels are dealt by frame and sorted, so an Arrow batch holds many small frames, which are cut out of it together.
    """
    with_import_path(px.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(FRAME))

    def packed(x: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        stream, number, r, c, v = x
        sizes = np.diff(np.append(starts, len(v)))
        h, w = (np.maximum.reduceat(y, starts) + 1 for y in (r, c))
        if not np.array_equal(r * np.repeat(w, sizes) + c, np.arange(len(v)) - np.repeat(starts, sizes)) or (sizes != h * w).any():
            raise ValueError("a frame has holes or repeated places")
        y = v.astype(np.uint8).tobytes()
        planes = [y[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        grey = [bytes([128]) * n for n in (-(-h // 2) * -(-w // 2)).tolist()]
        columns = [stream[starts], number[starts], w, h, w, planes, grey, grey]
        return pa.RecordBatch.from_arrays([pa.array(y, f.type) for y, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, starts in whole_runs(batches, 2):
            yield packed(x, starts)

    rows = px.select(*[F.col(c).cast("bigint") for c in ("stream_id", "frame_no", "r", "c", "v")])
    return rows.repartition("stream_id", "frame_no").sortWithinPartitions("stream_id", "frame_no", "r", "c").mapInArrow(run, FRAME)


#: Pixels in a batch of rows made from frames.
BATCH = 100_000


def frames_to_pixels(frames: DataFrame) -> DataFrame:
    """``(stream_id, frame_no, r, c, v)`` of the luma planes, without padding; many small frames, or lines of a large one, a batch."""

    def strips(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for stream, number, w, h, linesize, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            plane, step = luma(y, w, h, linesize), max(1, BATCH // max(1, w))
            for top in range(0, h, step):
                yield stream, number, top, plane[top : top + step]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for strip in strips(b):
                held.append(strip)
                n += strip[3].size
                if n >= BATCH:
                    yield rows(held)
                    held, n = [], 0
            if held:
                yield rows(held)

    def rows(held: list) -> pa.RecordBatch:
        sizes = [x[3].size for x in held]
        r = np.concatenate([np.repeat(np.arange(x[2], x[2] + len(x[3])), x[3].shape[1]) for x in held])
        c = np.concatenate([np.tile(np.arange(x[3].shape[1]), len(x[3])) for x in held])
        v = np.concatenate([x[3].ravel() for x in held]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in held], sizes)), pa.array(np.repeat([x[1] for x in held], sizes)), pa.array(r), pa.array(c), pa.array(v)], names=["stream_id", "frame_no", "r", "c", "v"])

    with_import_path(frames.sparkSession)
    planes = frames.select("stream_id", "frame_no", "width", "height", "linesize", "y")
    return planes.mapInArrow(run, "stream_id bigint, frame_no bigint, r bigint, c bigint, v bigint")


class FrameCounter(StatefulProcessor):
    """Numbers each stream's frames from where the rows before have left off; the next number is all that is kept."""

    def __init__(self, order: str, columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = int(self.next.get()[0]) if self.next.exists() else 0
        d = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        self.next.update((at + len(d),))
        yield d[self.columns].assign(frame_no=np.arange(at, at + len(d)))

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def numbered_stream(frames: DataFrame, order: str) -> DataFrame:
    """A stream of frames ``(stream_id, ...)`` with ``frame_no``, for sources that give none.

    Frames of a stream are numbered from 0 as micro-batches bring them, by ``order`` within one, and go on from there in
    later ones, also after a restart from the checkpoint. The state is one number a stream, in RocksDB, which this session's streams
    then use. A task sorts what a micro-batch brings of one stream, which the source's ``maxFilesPerTrigger`` bounds.
    """
    spark = with_import_path(frames.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([*frames.schema.fields, T.StructField("frame_no", T.LongType())])
    return frames.groupBy("stream_id").transformWithStateInPandas(FrameCounter(order, frames.columns), schema, "Append", "None")
