"""What the corpus operators share: Arrow batch mapping, shared tables, word splitting and hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pixelveil.functions.tables import shared_folder, small_or_not, stored, with_import_path  # noqa: F401  for the operators

#: Upper-case A-Z become lower case, other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte that is neither digit nor letter becomes a space.
ALNUM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER)
#: The number of words in a shingle, unless a caller says otherwise.
SHINGLE = 5


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, letters and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK_BYTES = 2 << 20
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64
_SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX, _WORD, _SHINGLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray, x: np.ndarray, factor: np.uint64) -> np.ndarray:
    h = (h ^ x) * factor
    return h ^ (h >> np.uint64(32))


def text_bytes(texts: pa.Array | list) -> tuple[bytes, np.ndarray]:
    """All texts as UTF-8 in a row, and where each begins (and the last ends); a null text is empty."""
    if isinstance(texts, list):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        return b"".join(parts), np.cumsum([0, *map(len, parts)], dtype=np.int64)
    whole = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    _, places, data = whole.buffers()
    at = np.frombuffer(places, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    return (bytes(data[int(at[0]) : int(at[-1])]) if data is not None else b""), at - at[0]


def word_hashes(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased, and where the words of each text begin.

    Words of up to eight bytes and of equal length never collide; others do as random numbers would.
    """
    n = len(data)
    low = data.translate(LOWER) + bytes(8)
    solid = _SOLID[np.frombuffer(low, np.uint8, n)]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < n)]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    eight = np.ndarray((n + 1,), "<u8", low, strides=(1,))
    h = sizes.astype(np.uint64) * _MIX
    some, k = np.arange(len(starts)), 0
    while len(some):
        x = eight[starts[some] + k] & _FIRST_BYTES[np.minimum(sizes[some] - k, 8)]
        h[some] = _mixed(h[some], x, _WORD)
        k += 8
        some = some[(sizes[some] > k) & (sizes[some] <= LONG_WORD)]
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(low[starts[i] : starts[i] + sizes[i]])
    return h, np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array | list, width: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; with fewer words, one of all words; none without words."""
    data, at = text_bytes(texts)
    out: list[np.ndarray] = []
    i, n = 0, len(at) - 1
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
            words, first = word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
            whole = np.full(max(0, len(words) - width + 1), width, np.uint64) * _MIX
            for k in range(width):
                whole = _mixed(whole, words[k : k + len(whole)], _SHINGLE)
            whole = _mixed(whole, whole >> np.uint64(29), _WORD)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= width:
                    out.append(np.unique(whole[a : b - width + 1]))
                    continue
                h = np.full(min(1, b - a), b - a, np.uint64) * _MIX
                for k in range(a, b):
                    h = _mixed(h, words[k : k + 1], _SHINGLE)
                out.append(_mixed(h, h >> np.uint64(29), _WORD))
            i = j
    return out


def fields(spec: str) -> list[T.StructField]:
    """``name type`` pairs of a DDL string as fields."""
    return T.StructType.fromDDL(spec).fields


def rows_from(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A record batch with the Arrow types that Spark expects for ``schema``."""
    arrow = to_arrow_schema(schema)
    arrays = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type != f.type else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def add_columns(df: DataFrame, reads: list[str], adds: str, make: Callable[[], Callable[..., list]], keep: list[str] | None = None, arrow: bool = False) -> DataFrame:
    """Append columns computed from Arrow batches; all rows stay, and all other columns or those of ``keep``.

    ``make()`` runs once per task and returns the function of the columns in ``reads`` (Python lists, or Arrow arrays
    if ``arrow``) to the list of new columns. A new column replaces an input column of the same name, in any case.
    """
    with_import_path(df.sparkSession)
    new = fields(adds)
    names = {f.name.lower() for f in new}
    stay = [f.name for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    df = df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in dict.fromkeys([*stay, *reads])])
    schema = T.StructType([df.schema[c] for c in stay] + new)
    spots = [df.columns.index(c) for c in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield rows_from(schema, [*b.columns[: len(stay)], *f(*(b.column(i) if arrow else b.column(i).to_pylist() for i in spots))])

    return df.mapInArrow(run, schema)


def make_rows(df: DataFrame, out: str, make: Callable[[], Callable[..., list]], arrow: bool = False) -> DataFrame:
    """Other rows from Arrow batches: ``make()`` returns a function of all columns of ``df`` (lists, or Arrow arrays if ``arrow``) to columns of ``out``.

    If the function has an attribute ``end``, that is called after the last batch of a task and gives more rows.
    """
    with_import_path(df.sparkSession)
    schema = T.StructType.fromDDL(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield rows_from(schema, f(*(b.columns if arrow else (c.to_pylist() for c in b.columns))))
        if hasattr(f, "end"):
            yield rows_from(schema, f.end())

    return df.mapInArrow(run, schema)
