"""Three ways to run the same operators: relational windows, halo tiles, or one Arrow kernel per image.

Windows and tiles spread an image of any size over tasks. Windows hold a line of an image and stay in the JVM; tiles hold a bounded
square, are shuffled once for any window size, and take many small images at a time. The kernel form needs images that fit a
task, such as video frames, and is the only one that streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pixelveil.functions.pixel import SEED, target_rms
from pixelveil.functions.runs import whole_runs
from pixelveil.functions.tables import with_import_path
from pixelveil.operators import marking, predictor, tiles
from pixelveil.operators.neighbourhood import check
from pixelveil.sources.planes import read_signal


class Backend(Protocol):
    def embed(self, px: DataFrame, **options) -> DataFrame: ...
    def detect(self, px: DataFrame, **options) -> DataFrame: ...


class RelationalBackend:
    """Windows, aggregates and joins."""

    embed = staticmethod(marking.embed)
    detect = staticmethod(marking.detect)


class TileBackend:
    """Tiles with a halo."""

    embed = staticmethod(tiles.embed)
    detect = staticmethod(tiles.detect)


def signal_array(rows: int, cols: int, seed: int = SEED) -> np.ndarray:
    """The deterministic signal of a whole plane."""
    r, c = np.arange(rows, dtype=np.int64)[:, None], np.arange(cols, dtype=np.int64)[None, :]
    a = (r * 7919 + c * 104729 + seed) % 2147483647 * 48271 % 2147483647
    b = (r * 15485863 + c * 32452843 + 17) % 2147483647 * 16807 % 2147483647
    return np.sqrt(-2 * np.log((a + 1) / 2147483648.0)) * np.cos(b * 6.283185307179586 / 2147483647.0)


def _near(x: np.ndarray, p: int, border: str) -> np.ndarray:
    """All p*p shifts of a plane, centre included."""
    pad, (h, w) = p // 2, x.shape
    wide = np.pad(x, pad, mode="edge" if border == "edge" else "constant")
    return np.stack([wide[i : i + h, j : j + w] for i in range(p) for j in range(p)])


def _fit(near: np.ndarray, p: int):
    """Coefficients (None if unsolvable) and the neighbours as rows."""
    flat = near.reshape(p * p, -1)
    mid = p * p // 2
    x = np.delete(flat, mid, 0)
    k = predictor.solve((x @ x.T)[None].copy(), (x @ flat[mid])[None])[0]
    return (None if np.isnan(k).any() else k), x


def _mask(plane, near, e, mask, p):
    if mask == "ME":
        top = np.abs(e).max()
        return np.abs(e) / top if top else None
    s, q = near.sum(0), (near * near).sum(0)
    var = np.maximum((p * p * q - s * s) / p**4, 0)
    return var / (1 + var)


def embed_plane(plane: np.ndarray, signal: np.ndarray | None = None, mask: str = "ME", p: int = 3, psnr: float = 40.0, border: str = "zero"):
    """The marked plane (not quantised) and the strength; the plane itself and None where nothing can be embedded."""
    check(p, border)
    x = plane.astype(float)
    w = signal_array(*x.shape) if signal is None else signal
    near = _near(x, p, border)
    e = None
    if mask == "ME":
        k, n = _fit(near, p)
        if k is None:
            return x, None
        e = x - (k @ n).reshape(x.shape)
    m = _mask(x, near, e, mask, p)
    rms = 0 if m is None else np.sqrt(np.mean((m * w) ** 2))
    if not rms:
        return x, None
    a = target_rms(psnr) / rms
    return np.clip(x + a * m * w, 0, 255), float(a)


def detect_plane(plane: np.ndarray, signal: np.ndarray | None = None, mask: str = "ME", p: int = 3, border: str = "zero") -> float:
    """The normalised correlation; 0 for an unsolvable plane or a zero norm."""
    check(p, border)
    x = plane.astype(float)
    w = signal_array(*x.shape) if signal is None else signal
    near = _near(x, p, border)
    k, n = _fit(near, p)
    if k is None:
        return 0.0
    ez = x - (k @ n).reshape(x.shape)
    m = _mask(x, near, ez, mask, p)
    if m is None:
        return 0.0
    u = m * w
    eu = u - (k @ np.delete(_near(u, p, border).reshape(p * p, -1), p * p // 2, 0)).reshape(u.shape)
    norm = np.sqrt((ez * ez).sum() * (eu * eu).sum())
    return float((ez * eu).sum() / norm) if norm else 0.0


class ArrowBackend:
    """One kernel call per image, for images that fit a task's memory; small images come many to an Arrow batch."""

    @staticmethod
    def _each(px: DataFrame, out: str, make: Callable[[int, np.ndarray], list]) -> DataFrame:
        """``make`` of every image's number and plane gives columns of ``out``."""
        schema = to_arrow_schema(T.StructType.fromDDL(out))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (img, r, c, v), starts in whole_runs(batches, 1):
                held = []
                for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(img)], strict=True):
                    h, w = int(r[a:z].max()) + 1, int(c[a:z].max()) + 1
                    if not np.array_equal(r[a:z] * w + c[a:z], np.arange(h * w)):
                        raise ValueError("the grid has holes or repeated places")
                    held.append(make(int(img[a]), v[a:z].reshape(h, w)))
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type, from_pandas=True) for x, f in zip(columns, schema, strict=True)], schema=schema)

        with_import_path(px.sparkSession)
        rows = px.select("img", "r", "c", F.col("v").cast("double").alias("v"))
        return rows.repartition("img").sortWithinPartitions("img", "r", "c").mapInArrow(run, out)

    @classmethod
    def embed(cls, px: DataFrame, quantize: bool = True, **options) -> DataFrame:
        def make(img: int, plane: np.ndarray) -> list:
            y, a = embed_plane(plane, **options)
            r, c = np.divmod(np.arange(y.size), y.shape[1])
            y = np.floor(y).astype(np.int64) if quantize else y
            return [np.full(y.size, img), r, c, y.ravel(), np.full(y.size, np.nan if a is None else a)]

        return cls._each(px, f"img bigint, r bigint, c bigint, y {'bigint' if quantize else 'double'}, strength double", make)

    @classmethod
    def detect(cls, px: DataFrame, **options) -> DataFrame:
        return cls._each(px, "img bigint, correlation double", lambda img, plane: [[img], [detect_plane(plane, **options)]])


@dataclass(frozen=True)
class Marker:
    """A signal of one size with its parameters: what embeds into and detects in images of that size, and refuses others.

    ``signal`` is a table (r, c, w); ``create`` reads it from a file.
    """

    rows: int
    cols: int
    signal: DataFrame
    p: int = 3
    psnr: float = 40.0
    border: str = "zero"
    backend: type = TileBackend

    def __post_init__(self):
        if self.rows < 1 or self.cols < 1:
            raise ValueError("rows and columns must be at least 1")
        check(self.p, self.border)
        target_rms(self.psnr)

    @classmethod
    def create(cls, spark: SparkSession, rows: int, cols: int, path: str, p: int = 3, psnr: float = 40.0, **options) -> Marker:
        """With the signal of a file or of its segments, whose size must be rows * cols values."""
        return cls(rows, cols, read_signal(spark, path, rows, cols), p, psnr, **options)

    def embed(self, px: DataFrame, mask: str = "ME", quantize: bool = True) -> DataFrame:
        return self.backend.embed(px, signal=self.signal, mask=mask, p=self.p, psnr=self.psnr, border=self.border, quantize=quantize)

    def detect(self, px: DataFrame, mask: str = "ME") -> DataFrame:
        return self.backend.detect(px, signal=self.signal, mask=mask, p=self.p, border=self.border)
