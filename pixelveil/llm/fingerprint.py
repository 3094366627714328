"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least hashes of a text's distinct shingles, 48 bits each. Sketches of parts merge into that
of their union, and give resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHINGLE, add_columns, rows_from, shingle_sets, small_or_not, stored, with_import_path

K = 128
_TOP = float(1 << 48)


def sketch(text: str | None, k: int = K, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct least hashes, at most ``k``; none for a null or wordless text."""
    return sketches([text], k, width)[0]


def sketches(texts: pa.Array | list, k: int = K, width: int = SHINGLE) -> list[np.ndarray]:
    """``sketch`` of each text."""
    return [np.unique(h >> np.uint64(16))[:k] for h in shingle_sets(texts, width)]


def encode(h: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def decode(s: str) -> np.ndarray:
    b = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(b), 2), np.uint8), b], 1).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def distinct(h: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(h)) if len(h) < k else (k - 1) / (float(h[-1]) + 1) * _TOP


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(a) + len(b) - len(np.union1d(a, b))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike, an empty one is like no other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u = merge(a, b, k)
    low_a, low_b = a[a <= u[-1]], b[b <= u[-1]]
    return _shared(low_a, low_b) / len(u)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * (distinct(a, k) + distinct(b, k)) / (1 + j) / distinct(a, k))


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, width: int = SHINGLE) -> DataFrame:
    """Every row with ``fingerprint`` (base64 of the sketch) and ``n_distinct`` (estimated shingles).

    A null or wordless text has an empty fingerprint. Equal texts have equal ones. Other columns stay; one that has
    the name of an added column is replaced. An empty table gives no rows.
    """

    def make():
        def f(texts):
            s = sketches(texts, k, width)
            return [[encode(x) for x in s], [distinct(x, k) for x in s]]

        return f

    return add_columns(docs, [text], "fingerprint string, n_distinct double", make, arrow=True)


#: Characters of text that a bucket of neighbouring documents has on average, most buckets that cuts make, and rows of small tables that may be broadcast.
BUCKET_CHARS, MOST_BUCKETS, MOST_BROADCAST = 8_000_000, 65_536, 100_000
#: Rows for each bucket, besides one for each id, from which the cuts are found: an id has as many as its share of the characters asks.
WEIGHTS = 50
#: Stands for a null id, so that nulls come first.
_NULL = -(1 << 63)


def _bucket(c, cuts: list[int]):
    """How many of the sorted ``cuts`` are at most ``c``, by halving; the expression is as large for any number of cuts."""
    if not cuts:
        return F.lit(0)
    grid = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.lit([1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.coalesce(F.try_element_at(grid, at + k) <= c, F.lit(False)), at + k).otherwise(at))


def with_next(docs: DataFrame, out: str, make, doc_id: str = "doc_id", text: str = "text", bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Stream documents in order of id, each with the next one's text (the last with the first's), through a function.

    ``make()`` gives a function of lists (ids, texts, next texts) to columns of ``out``. Rows are dealt once into buckets of
    neighbouring ids, about ``bucket_chars`` characters each, and sorted there; the first row of each bucket is also sent to
    the one before. Null ids come first, null texts are empty. Rows of one id follow by a hash of the text, then by text, and
    an id with more characters than a bucket (or the null id) has several buckets, by that hash; only rows that are equal in
    both stay together. A single document is its own next one, an empty table gives no rows. Other columns play no part.
    """
    spark = with_import_path(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NULL)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    sizes = stored(base.groupBy("id").agg(F.sum(F.length("text").cast("bigint")).alias("chars")), "sizes")
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    n = int(min(MOST_BUCKETS, max(1, total // bucket_chars)))
    weighed = sizes.select("id", F.explode(F.array_repeat(F.lit(0), F.ceil(F.col("chars") * (WEIGHTS * n) / max(1, total)).cast("int")))) if n > 1 else sizes  # ids by their characters
    cuts = weighed.agg(F.percentile_approx("id", [i / n for i in range(1, n)], min(100_000, max(10_000, 4 * n)))).first()[0] if n > 1 else []
    large = sizes.where(F.col("chars") > bucket_chars).select("id", F.ceil(F.col("chars") / bucket_chars).alias("parts"))
    alone = [r.id for r in large.collect()]  # at most as many as buckets of that size
    cuts = sorted({*(cuts or []), *alone, *(i + 1 for i in alone if i < (1 << 63) - 1)})
    part = F.coalesce(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("parts")), F.lit(0)).cast("int")
    dealt = base.join(small_or_not(large, len(alone), MOST_BROADCAST), "id", "left").select("id", "tie", "text", _bucket(F.col("id"), cuts).alias("bucket"), part.alias("part"))
    least = sorted((r.bucket, r.part, *r.head) for r in dealt.groupBy("bucket", "part").agg(F.min(F.struct("id", "tie")).alias("head")).collect())  # four numbers a bucket
    before = [x[:2] for x in [*least[-1:], *least[:-1]]]
    heads = spark.createDataFrame([(i, t, *p) for (_, _, i, t), p in zip(least, before, strict=True)], "id bigint, tie bigint, bucket int, part int")
    first = base.join(small_or_not(heads, len(least), MOST_BROADCAST), ["id", "tie"]).groupBy("id", "tie", "bucket", "part").agg(F.min("text").alias("text"))
    columns = ["bucket", "part", "after", "id", "tie", "text"]
    rows = dealt.withColumn("after", F.lit(0)).select(columns).union(first.withColumn("after", F.lit(1)).select(columns))
    rows = rows.repartition(max(1, len(least)), "bucket", "part").sortWithinPartitions(*columns).select("after", "id", "text")
    schema = T.StructType.fromDDL(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held = make(), None
        for b in batches:
            got = []
            for after, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None:
                    got.append((*held, t))
                held = None if after else (None if i == _NULL else i, t)
            if got:
                yield rows_from(schema, f(*map(list, zip(*got, strict=True))))

    return rows.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]
