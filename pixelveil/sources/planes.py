"""Pixel relations: from image and signal files, and derived from the test tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelveil.functions.pixel import SEED, signal_value, visible
from pixelveil.functions.tables import file_system, stored, with_import_path

#: Largest number of rows or columns of an image file, and values of a signal in a batch.
MOST, VALUES = 65536, 1 << 17


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, img, r, c, red, green, blue, alpha)`` of colour images; gray files are refused, alpha is null without one.

    Colours are 0 where alpha is 0. ``img`` is a hash of the path.
    """
    with_import_path(spark)
    files = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    ok = F.assert_true((F.col("nChannels").isin(3, 4)) & (F.col("height") <= MOST) & (F.col("width") <= MOST), F.concat(F.lit("3 or 4 channels and at most 65536 rows and columns are needed: "), F.col("origin")))
    files = files.where(ok.isNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for x in d.itertuples():
                px = np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.nChannels)  # blue, green, red and alpha
                for top in range(0, x.height, 256):
                    part = px[top : top + 256]
                    r, c = np.divmod(np.arange(part.shape[0] * x.width), x.width)
                    flat = part.reshape(-1, x.nChannels).astype("int64")
                    yield pd.DataFrame({"path": x.origin, "r": r + top, "c": c, "red": flat[:, 2], "green": flat[:, 1], "blue": flat[:, 0], "alpha": pd.array(flat[:, 3] if x.nChannels == 4 else [None] * len(flat), "Int64")})

    px = files.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "path string, r bigint, c bigint, red bigint, green bigint, blue bigint, alpha bigint")
    return px.select("path", F.xxhash64("path").alias("img"), "r", "c", *[F.coalesce(visible(F.col(x), F.col("alpha")), F.col(x)).alias(x) for x in ("red", "green", "blue")], "alpha")


def read_signal(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """``(r, c, w)`` from row-major 32-bit floats, whose length must be rows * cols * 4.

    ``path`` is one file, which is split by byte ranges and read line by line, so it may be of any size; or the folder of segments that
    ``write_signal_file`` makes. Any file system that Spark reads will do.
    """
    if rows < 1 or cols < 1:
        raise ValueError("rows and columns must be at least 1")
    with_import_path(spark)
    fs, at = file_system(spark, path)
    folder = fs.getFileStatus(at).isDirectory()
    size = fs.getContentSummary(at).getLength()
    if size != rows * cols * 4:
        raise ValueError(f"the signal's size is wrong: {path} has {size} bytes, {rows} x {cols} values need {rows * cols * 4}")
    if folder:
        files = spark.read.format("binaryFile").load(path)
        lines = files.select(F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("bigint").alias("r"), F.col("content").alias("line"))
    else:
        conf = {"fixedlengthinputformat.record.length": str(cols * 4)}
        records = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        lines = spark.createDataFrame(records.map(lambda x: (x[0] // (cols * 4), bytes(x[1]))), "r bigint, line binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, line in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = np.frombuffer(line.as_buffer(), "<f4")
                for i in range(0, len(w), VALUES):
                    r, c = np.divmod(np.arange(i, min(i + VALUES, len(w))), cols)
                    yield pa.RecordBatch.from_arrays([pa.array(r + first), pa.array(c), pa.array(w[i : i + VALUES].astype(float))], names=["r", "c", "w"])

    return lines.mapInArrow(run, "r bigint, c bigint, w double")


def make_signal(spark: SparkSession, rows: int, cols: int, seed: int = SEED) -> DataFrame:
    """``(r, c, w)``: the deterministic signal of a plane of any size."""
    if rows < 1 or cols < 1:
        raise ValueError("rows and columns must be at least 1")
    at = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    return at.withColumn("w", signal_value(F.col("r"), F.col("c"), seed))


def first_video(streams: DataFrame) -> DataFrame:
    """``(source, stream_index)``: the first video stream of each source; fails for a source without one."""
    per = streams.groupBy("source").agg(F.min(F.when(F.col("type") == "video", F.col("stream_index"))).alias("stream_index"))
    return per.where(F.assert_true(F.col("stream_index").isNotNull(), F.concat(F.lit("no video stream in "), F.col("source"))).isNull())


def to_long(rgb: DataFrame) -> DataFrame:
    """``(img, r, c, ch, v)`` from wide channels."""
    return rgb.select("img", "r", "c", F.expr("stack(3, 0, red, 1, green, 2, blue) as (ch, v)"))


def to_wide(px: DataFrame) -> DataFrame:
    """Channels as columns from the long form."""
    wide = px.groupBy("img", "r", "c").pivot("ch", [0, 1, 2]).agg(F.first("v"))
    return wide.toDF("img", "r", "c", "red", "green", "blue")


def without_padding(px: DataFrame, linesize: str = "linesize", width: str = "width") -> DataFrame:
    """``(img, r, c, v)`` from bytes ``(img, pos, v)`` of lines that may be longer than their images."""
    at = px.where(F.col("pos") % F.col(linesize) < F.col(width))
    return at.select("img", F.floor(F.col("pos") / F.col(linesize)).alias("r"), (F.col("pos") % F.col(linesize)).cast("bigint").alias("c"), "v")


def transposed(px: DataFrame) -> DataFrame:
    return px.select(*[F.col({"r": "c", "c": "r"}.get(x, x)).alias(x) for x in px.columns])


def to_rows(px: DataFrame) -> DataFrame:
    """``(img, r, px)``: one array per row of an image."""
    line = px.groupBy("img", "r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("px"))
    return line.select("img", "r", F.transform("px", lambda x: x["v"]).alias("px"))


def _byte(e):
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), e.cast("double") * 240 + 128))).cast("bigint")


def embeddings_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image, a row per vector."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    return e.select(F.lit(0).cast("bigint").alias("img"), F.col("vec_id").alias("r"), F.col("pos").cast("bigint").alias("c"), _byte(F.col("e")).alias("v"))


def text_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image per document that has text, 64 characters wide; the last line is filled with zeros."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") > 0)
    whole = F.rpad("text", (F.ceil(F.length("text") / 64) * 64).cast("int"), F.lit("\0"))
    at = d.select(F.col("doc_id").alias("img"), F.posexplode(F.split(whole, "")).alias("pos", "ch")).where("ch <> ''")
    return at.select("img", F.floor(F.col("pos") / 64).alias("r"), (F.col("pos") % 64).cast("bigint").alias("c"), F.ascii("ch").cast("bigint").alias("v"))


def numbered(frames: DataFrame, order: str) -> DataFrame:
    """Frame numbers from 0 by ``order`` within each stream, for batch tables that have none.

    Rows are dealt by ranges of (stream, order) and numbered within a range, to which the counts of the ranges before are
    added, so a long stream isn't sorted in one task.
    """
    dealt = stored(frames.repartitionByRange("stream_id", order).withColumn("part__", F.spark_partition_id()), "frames")
    before = Window.partitionBy("stream_id").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("stream_id", "part__").count().select("stream_id", "part__", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset__"))
    at = F.row_number().over(Window.partitionBy("stream_id", "part__").orderBy(order)).cast("bigint") - 1
    return dealt.withColumn("frame_no", at).join(offset, ["stream_id", "part__"]).withColumn("frame_no", F.col("frame_no") + F.col("offset__")).select(*frames.columns, "frame_no")


def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(stream_id, frame_no, r, c, v)``: a vector is an 8 x 8 frame, a label a stream."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = numbered(e.select(F.col("label").cast("bigint").alias("stream_id"), "vec_id", "embedding"), "vec_id").select("stream_id", "frame_no", F.posexplode("embedding").alias("pos", "e"))
    return at.select("stream_id", "frame_no", F.floor(F.col("pos") / 8).alias("r"), (F.col("pos") % 8).cast("bigint").alias("c"), _byte(F.col("e")).alias("v"))


def rgb_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of the vectors' plane are one row of colours, those of an incomplete last triple are dropped; alpha is 0 at every seventh pixel."""
    g = embeddings_plane(spark, sf_dir).select("img", F.floor(F.col("r") / 3).alias("r"), "c", (F.col("r") % 3).cast("int").alias("ch"), "v")
    whole = to_wide(g).where("red is not null and green is not null and blue is not null")
    return whole.withColumn("alpha", F.when((F.col("r") * 64 + F.col("c")) % 7 == 0, 0).otherwise(255))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 frames of the events' values by id; a frame that isn't whole is dropped."""
    at = F.col("event_id")
    v = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("value"))))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(at / 64).alias("frame_no"), F.struct((at % 64).alias("pos"), v.alias("v")).alias("x"))
    whole = e.groupBy("frame_no").agg(F.collect_list("x").alias("xs")).where(F.size("xs") == 64).select("frame_no", F.explode("xs").alias("x"))
    return whole.select(F.lit(0).cast("bigint").alias("stream_id"), "frame_no", F.floor(F.col("x.pos") / 8).alias("r"), (F.col("x.pos") % 8).alias("c"), F.col("x.v").alias("v"))
