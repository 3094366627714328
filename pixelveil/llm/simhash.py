"""SimHash near duplicates by anchor-point covering.

A fingerprint has a bit where over half of a text's shingle hashes have it. To find fingerprints within two bits of each other,
each half of 32 bits is covered by a code: two of them differ by one bit at most in at least one half. The anchors are the
words of the Hamming code of length 31, whose covering radius is 1 (the 32nd bit of a half plays no part): every half is
within 1 of one anchor, its home, and a partner of it then is within 1 + 1 of that anchor. So a fingerprint goes to every
anchor within 2, which are 16 (or 1, if it is an anchor itself), and at each anchor those at home there are compared
with all that came, on all 64 bits.

Equal fingerprints are one before that. An anchor with many of them is cut to a grid of bounded cells. A task puts out trees
of linked fingerprints, not pairs, and star contraction joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, rows_from, small_or_not, space_words, stored, with_import_path
from .graph import components

#: Words of a shingle, the seed of its hash, and differing bits at which fingerprints link.
WIDTH, SEED, NEAR = 3, 42, 2
#: Length of the code's words, and its parity checks: bit i is in check k if bit k of i + 1 is set.
LENGTH = 31
CHECKS = [sum(1 << i for i in range(LENGTH) if (i + 1) >> k & 1) for k in range(5)]
#: Shingles hashed at a time, fingerprints of an anchor's cell, and pairs compared at a time.
CHUNK, CELL, PAIRS = 1 << 17, 4096, 1 << 20
#: Anchors that may be broadcast (24 bytes each).
MOST_BROADCAST = 500_000


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64 bits, as a signed number; 0 without words. Shingles count as often as they occur."""
    words = space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    begins = np.concatenate([[0], ends[: len(ends) - width] + 1])
    ends, counts = ends[width - 1 :], np.zeros(64, np.int64)
    del words
    for i in range(0, len(begins), CHUNK):
        places = zip(begins[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in places], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begins), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with ``fingerprint``, a long, of every whole text."""

    def make():
        return lambda texts: [[fingerprint(t, width) for t in texts]]

    return add_columns(docs, ["text"], "fingerprint bigint", make, keep=keep)


def as_hex(fingerprint: str | Column = "fingerprint") -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _anchors(half: int) -> Column:
    """``array<struct<anchor, home>>`` of one half of the column fp: the anchor within 1, and those at 2."""
    word = f"(shiftrightunsigned(fp, {32 * half}) & {(1 << LENGTH) - 1}L)"
    syndrome = " + ".join(f"shiftleft(bit_count({word} & {mask}L) & 1, {k})" for k, mask in enumerate(CHECKS))
    flip = lambda i: f"if({i} > 0, shiftleft(1L, {i} - 1), 0L)"
    at = lambda w: f"({w}) | shiftleft({half}L, {LENGTH})"
    near = f"transform(filter(sequence(1, {LENGTH}), i -> (i ^ s) > i), i -> struct({at(f'{word} ^ {flip("i")} ^ {flip("(i ^ s)")}')} as anchor, false as home))"
    home = f"array(struct({at(f'{word} ^ {flip("s")}')} as anchor, true as home))"
    return F.expr(f"transform(array({syndrome}), s -> concat({home}, {near}))[0]")


def anchored(distinct: DataFrame) -> DataFrame:
    """``(anchor, fp, home)`` of distinct fingerprints ``fp``: every anchor within covering radius and threshold, and whether it is the nearest."""
    return distinct.select("fp", F.explode(F.concat(_anchors(0), _anchors(1))).alias("at")).select("at.anchor", "fp", "at.home")


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """``(anchor, i, j, fp, kind)``: home fingerprints (kind 1, or 2 where they also came) and others (kind 0) of each cell.

    An anchor with more than ``cell`` rows has so many parts that each is about that large; cell (i, j) compares the home rows of part i
    with all rows of part j.
    """
    many = stored(rows.groupBy("anchor").count().where(F.col("count") > cell).select("anchor", F.ceil(F.col("count") / cell).cast("int").alias("parts")), "anchors")
    n = many.count()
    kind = F.when(F.col("home"), 2).otherwise(0)
    if not n:
        return rows.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", kind.alias("kind"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    asks = F.when(F.col("home"), F.transform(every, lambda x: F.struct(own.alias("i"), x.alias("j"), F.lit(1).alias("kind"))))
    comes = F.transform(every, lambda x: F.struct(x.alias("i"), own.alias("j"), F.lit(0).alias("kind")))
    plain = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), kind.alias("kind")))
    to = F.when(F.col("parts").isNull(), plain).otherwise(F.concat(F.coalesce(asks, F.array()), comes))
    return rows.join(small_or_not(many, n, MOST_BROADCAST), "anchor", "left").select("anchor", "fp", F.explode(to).alias("x")).select("anchor", "x.i", "x.j", "fp", "x.kind")


def _trees(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between places below ``n``, the (place, root) of every place that isn't its own root."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], least)
        np.minimum.at(root, root[right], least)
        root = root[root]
        if np.array_equal(root, before):
            break
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _linked(fp: np.ndarray, kind: np.ndarray, starts: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked fingerprints (a, b) of cells that begin at ``starts``, as trees; the home rows of a cell are compared with all that came."""
    sizes = np.diff(np.append(starts, len(fp)))
    cell = np.repeat(np.arange(len(starts)), sizes)
    home = np.flatnonzero((kind > 0) & (sizes[cell] > 1))
    work = np.cumsum(sizes[cell[home]])
    i = 0
    while i < len(home):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + PAIRS, "right")))
        some, n = home[i:j], sizes[cell[home[i:j]]]
        left = np.repeat(some, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[cell[some]], n)
        ok = (np.bitwise_count(fp[left] ^ fp[right]) <= near) & (kind[right] != 1) & (fp[left] != fp[right])
        left, right = left[ok], right[ok]
        places, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        a, b = _trees(at[: len(left)], at[len(left) :], len(places))
        yield fp[places[a]].view(np.int64), fp[places[b]].view(np.int64)
        i = j


def links(distinct: DataFrame, near: int = NEAR, cell: int = CELL) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp``, fewer than all pairs but joining the same ones."""
    if not 0 <= near <= 2:
        raise ValueError("anchors within two bits cover thresholds of 0 to 2")
    rows = _cells(anchored(distinct), cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            x = x if rest is None else [np.concatenate(y) for y in zip(rest, x, strict=True)]
            change = np.flatnonzero((np.diff(x[0]) != 0) | (np.diff(x[1]) != 0) | (np.diff(x[2]) != 0)) + 1
            end = int(change[-1]) if len(change) else 0
            rest = [c[end:] for c in x]
            if end:
                yield from found([c[:end] for c in x], np.append(0, change[:-1]))
        if rest is not None:
            yield from found(rest, np.zeros(1, np.int64))

    def found(x: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in _linked(x[3].astype(np.int64).view(np.uint64), x[4], starts, near):
            if len(a):
                yield rows_from(schema, [pa.array(a), pa.array(b)])

    schema = T.StructType.fromDDL("a bigint, b bigint")
    return rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, near: int = NEAR, cell: int = CELL) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``: the smallest id that links reach.

    Null and wordless texts have fingerprint 0 and link like others; texts of fewer words than a shingle are one shingle. Rows
    with a null id get a fingerprint and no component, and join nothing; repeated rows are given each. An empty table gives no rows,
    other columns play no part, texts may be of any length.
    """
    with_import_path(docs.sparkSession)
    own = stored(fingerprints(docs.select("doc_id", "text"), keep=["doc_id"]), "fingerprints")
    least = stored(own.where("doc_id is not null").groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    reached = stored(components(stored(links(least.select("fp"), near, cell), "links")), "reached")
    ids = reached.join(least, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = reached.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    every = stored(least.join(linked, "fp", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("component_id", "least").alias("component_id")), "classes")
    out = own.join(every, "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
