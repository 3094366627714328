"""Hard-negative mining by distributed radix selection.

Each anchor's positives are its best rows of the same label, and each (anchor, positive) has a window of scores in which
negatives are looked for. Both are the best k rows of a window of integer scores. One pass scores all rows against
the anchors of a round and counts, for each window, the scores by their highest digit below the window's upper end; a task
sends only digits up to the one in which it has seen k rows itself, as the k-th of all can't lie beyond. The digit that holds the k-th
score becomes the new window, until few rows lie at or above it or it is one score. A last pass gathers the rows at or above it,
of each task the best k.

Anchors go round by round, at most about ``ROUND`` of them, so what every task holds is bounded; rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelveil.functions.tables import new_path

from .common import rows_from, stored, with_import_path

#: Anchors of a round, on average; scores held at a time; bits of a digit; rows at or above a window's k-th digit that are gathered as they are.
ROUND, SCORES, DIGIT, FEW = 4096, 1 << 20, 7, 64
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_EXACT = 1 << 53


def prepared(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """``(row, vec_id, label, v)``: stored rows that take part, numbered, with each component x as floor(scale * x).

    Rows with a null id, label or vector, or any null or non-finite component, take no part.
    """
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    part = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("e"))
    part = part.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", sound))
    v = F.transform("e", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return stored(part.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("bigint").alias("label"), v.alias("v")), "vectors")


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end with zeros."""
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(v), width)
    out = np.zeros((len(v), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


@dataclass
class Anchors:
    """The anchors of a round: row numbers, ids, labels, vectors."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray


@dataclass
class Windows:
    """Scores from ``lo`` to ``hi`` of an anchor (by place, ascending), ``above`` of which the rows counted lie above ``top``, the window's end now."""

    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    same: bool  # rows of the anchor's label, or of others

    def __post_init__(self):
        self.floor, self.top, self.above = self.lo.copy(), self.hi.copy(), np.zeros(len(self.lo), np.int64)

    def shift(self) -> np.ndarray:
        """Bits below the highest digit of what is left of each window."""
        width = np.maximum(self.top - self.floor, 0)
        return np.maximum(np.frexp(width.astype(float))[1].astype(np.int64) - DIGIT, 0)

    def some(self, at: np.ndarray) -> Windows:
        out = Windows(self.anchor[at], self.lo[at], self.hi[at], self.same)
        out.floor, out.top, out.above = self.floor[at], self.top[at], self.above[at]
        return out


def _scored(b: pa.RecordBatch, anchors: Anchors, windows: Windows, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, score, vec_id) of the rows of a batch that lie from ``low`` to ``high`` of a window."""
    m = len(anchors.row)
    first, last = np.searchsorted(windows.anchor, np.arange(m)), np.searchsorted(windows.anchor, np.arange(m), "right")
    used = np.flatnonzero(last > first)
    if not len(used):
        return
    first, count = first[used], (last - first)[used]
    least, most = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    x, a = _matrix(b.column(3), anchors.v.shape[1]), anchors.v[used]
    largest = int(np.abs(x).max(initial=0)) * int(np.abs(a).max(initial=0)) * max(1, a.shape[1])
    if largest >= 1 << 63:
        raise OverflowError("inner products don't fit 64 bits")
    kind = np.float64 if largest < _EXACT else np.int64
    x, a = x.astype(kind), a.astype(kind).T
    row, ids, label = (b.column(i).to_numpy() for i in range(3))
    step = max(1, SCORES // len(used))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ a
        ok = (s >= least) & (s <= most) & ((label[i : i + step, None] == anchors.label[used]) == windows.same) & (row[i : i + step, None] != anchors.row[used])
        at, k = np.nonzero(ok)
        score = s[at, k].astype(np.int64)
        for j in range(int(count.max())):
            has = count[k] > j
            w, v = first[k[has]] + j, score[has]
            good = (v >= low[w]) & (v <= high[w])
            yield w[good], v[good], ids[i + at[has][good]]


def _digits(rows: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """``(w, digit, n)`` of each window's rows by the highest digit, up to a task's k-th row."""
    shift, need = windows.shift(), k - windows.above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shift) << DIGIT
        n, held, some = np.zeros(size, np.int64), 0, []
        for b in batches:
            for w, v, _ in _scored(b, anchors, windows, windows.floor, windows.top):
                some.append((w << DIGIT) + (windows.top[w] - v >> shift[w]))
                held += len(w)
                if held > SCORES:
                    n, held, some = n + np.bincount(np.concatenate(some), minlength=size), 0, []
        if some:
            n += np.bincount(np.concatenate(some), minlength=size)
        n = n.reshape(-1, 1 << DIGIT)
        n[n.cumsum(1) - n >= need[:, None]] = 0
        w, digit = np.nonzero(n)
        yield rows_from(schema, [pa.array(w), pa.array(digit.astype(np.int32)), pa.array(n[w, digit])])

    schema = T.StructType.fromDDL("w bigint, digit int, n bigint")
    return rows.mapInArrow(run, schema)


def _narrowed(rows: DataFrame, anchors: Anchors, windows: Windows, k: int) -> np.ndarray:
    """One digit: ``floor``, ``top`` and ``above`` of each window follow its k-th score; true for those that need no other digit."""
    before = F.sum("n").over(Window.partitionBy("w").orderBy("digit")) - F.col("n")
    counts = _digits(rows, anchors, windows, k).groupBy("w", "digit").agg(F.sum("n").alias("n")).withColumn("before", before).where(F.col("before") < k).toArrow()
    w, digit, n, before = (counts.column(i).to_numpy() for i in range(4))
    shift, need = windows.shift(), k - windows.above
    hold = (before < need[w]) & (before + n >= need[w])
    w, digit, n, before = w[hold], digit[hold].astype(np.int64), n[hold], before[hold]
    top = windows.top[w] - (digit << shift[w])
    windows.floor[w] = np.maximum(windows.floor[w], top - (np.int64(1) << shift[w]) + 1)
    windows.top[w] = top
    windows.above[w] += before
    done = np.ones(len(windows.lo), bool)  # with fewer than k rows in all, they are gathered from the window's lower end on
    done[w] = (shift[w] == 0) | (windows.above[w] + n <= FEW)
    return done


def _gathered(rows: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """``(w, score, vec_id)``: of each window the rows at or above its ``floor``, of a task at most the best k."""

    def best(w, v, ids):
        order = np.lexsort((ids, -v, w))
        w, v, ids = w[order], v[order], ids[order]
        good = np.arange(len(w)) - np.searchsorted(w, w) < k
        return w[good], v[good], ids[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 3
        parts, n = [held], 0
        for b in batches:
            for x in _scored(b, anchors, windows, windows.floor, windows.hi):
                parts.append(x)
                n += len(x[0])
                if n > SCORES:
                    parts, n = [best(*map(np.concatenate, zip(*parts, strict=True)))], 0
        held = best(*map(np.concatenate, zip(*parts, strict=True)))
        yield rows_from(schema, [pa.array(x) for x in held])

    schema = T.StructType.fromDDL("w bigint, score bigint, vec_id bigint")
    return rows.mapInArrow(run, schema)


def best_of_windows(rows: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """``(w, rank, score, vec_id)``: the best k rows of each window, by score and then by the smaller id."""
    left = np.flatnonzero(windows.lo <= windows.hi)
    while len(left):
        some = windows.some(left)
        done = _narrowed(rows, anchors, some, k)
        windows.floor[left], windows.top[left], windows.above[left] = some.floor, some.top, some.above
        left = left[~done]
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
    return _gathered(rows, anchors, windows, k).withColumn("rank", rank).where(F.col("rank") <= k).select("w", "rank", "score", "vec_id")


def _round(rows: DataFrame, anchors: Anchors, norm: float, k: int, low: int) -> DataFrame:
    """``RESULT`` of a round's anchors."""
    m = len(anchors.row)
    reach = np.ceil(np.sqrt((anchors.v.astype(float) ** 2).sum(1)) * norm * (1 + 1e-9)).astype(np.int64) + 1  # no inner product is larger
    found = best_of_windows(rows, anchors, Windows(np.arange(m), -reach, reach, True), k).toArrow().sort_by([("w", "ascending"), ("rank", "ascending")])
    anchor, score, ids = (found.column(c).to_numpy() for c in ("w", "score", "vec_id"))
    windows = Windows(anchor, -(-low * score // 100), score, False)
    own, out = anchors.vec_id[anchor], best_of_windows(rows, anchors, windows, k)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_numpy()
            yield rows_from(schema, [pa.array(own[w]), pa.array(ids[w]), b.column(1), b.column(3), pa.array(score[w]), b.column(2)])

    schema = T.StructType.fromDDL(RESULT)
    return out.mapInArrow(name, schema)


def mine(rows: DataFrame, is_anchor: Column, k: int = 5, low: int = 80, anchors_a_round: int = ROUND) -> DataFrame:
    """``RESULT``: for each anchor row and each of its first ``k`` other rows of the same label, the first ``k`` rows of other labels.

    ``rows`` are ``prepared``. Negatives have ``low * positive_score <= 100 * negative_score <= 100 * positive_score``, so a
    negative positive_score has none. Higher scores come first, ties by smaller id. Every row counts by itself, so an id
    that comes twice is twice an anchor or a partner. Vectors of different lengths meet as if the shorter ended with
    zeros; a score beyond 64 bits fails. An empty table, or one without anchors, gives no rows.
    """
    spark = with_import_path(rows.sparkSession)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    width, norm, n = rows.agg(F.max(F.size("v")), F.sqrt(F.max(square)), F.count(F.when(is_anchor, 1))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    rounds = -(-n // anchors_a_round)
    anchors = rows.where(is_anchor).withColumn("round", F.pmod(F.xxhash64("row"), F.lit(rounds)).cast("int"))
    kept = new_path(spark, "anchors")
    anchors.write.partitionBy("round").parquet(kept)
    out = new_path(spark, "negatives")
    for i in range(rounds):
        t = spark.read.parquet(kept).where(F.col("round") == i).toArrow().combine_chunks()
        if t.num_rows:
            row, ids, label = (t.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            v = _matrix(pa.concat_arrays(t.column("v").chunks), width)
            _round(rows, Anchors(row, ids, label, v), norm, k, low).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)
