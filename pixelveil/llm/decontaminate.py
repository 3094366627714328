"""Benchmark decontamination by Wu-Manber search over words.

Patterns of one length m share tables over blocks of two adjacent words (one, if m = 1). A block's shift is
its least distance from the end of any pattern; blocks of no pattern give the full shift m - 1, so most
document words are never looked at. At shift 0 the suffix block's bucket, split by first word, selects the
patterns to compare word by word.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, alnum_words, make_rows, stored

WINDOW = 10
#: Windows in one set of tables. A larger benchmark is searched in several passes, each over all documents.
BLOCK_WINDOWS = 200_000


def item_windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    """Distinct windows of consecutive words, words joined by a space; a short text is one window."""
    w = alnum_words(text)
    return list({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) if w else []


class WuManber:
    """Search for word sequences of one length; ``patterns`` maps each (words joined by a space) to any value."""

    def __init__(self, length: int, patterns: dict[bytes, object]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(lambda: defaultdict(list))
        for joined, value in patterns.items():
            w = joined.split(b" ")
            for end in range(self.block - 1, length):
                key = self._key(w, end)
                self.shift[key] = min(self.shift.get(key, self.most), length - 1 - end)
            self.bucket[self._key(w, length - 1)][w[0]].append((w, value))

    def _key(self, w: list[bytes], end: int):
        return (w[end - 1], w[end]) if self.block == 2 else w[end]

    def find(self, words: list[bytes]) -> list[tuple[int, object]]:
        """Start and value of every occurrence, by start."""
        m, n, at, get, most, pairs, out = self.length, len(words), self.length - 1, self.shift.get, self.most, self.block == 2, []
        while at < n:
            key = (words[at - 1], words[at]) if pairs else words[at]
            skip = get(key, most)
            if skip:
                at += skip
                continue
            start = at - m + 1
            for w, value in self.bucket[key].get(words[start], ()):
                if words[start : at + 1] == w:
                    out.append((start, value))
            at += 1
        return out


_KEPT: dict[object, list] = {}


def _searches(tables) -> list[WuManber]:
    """The searches of a broadcast's patterns, built once in a worker; those of another broadcast go."""
    key = getattr(tables, "_path", None) or id(tables)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = [WuManber(m, p) for m, p in sorted(tables.value.items())]
    return _KEPT[key]


def _windows(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    def make():
        def f(items, texts):
            rows = [(w, i) for i, t in zip(items, texts, strict=True) for w in item_windows(t, width)]
            return [[r[0] for r in rows], [r[1] for r in rows]]

        return f

    return make_rows(benchmark.select(F.col(item).cast("string"), F.col(text)), "win binary, item string", make).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every document row with ``n_words``, ``n_hit``, ``hit_spans`` (word ranges, end exclusive), ``items`` and ``contaminated``.

    A null or empty text has no words and no hits. A null item marks words but isn't listed; repeated items and
    windows count once; an item without words never occurs. An empty benchmark hits nothing, an empty ``docs``
    gives no rows. Other columns stay; one that has the name of an added column is replaced. The benchmark goes
    to the executors in sets of ``block_windows`` windows, split by hash, so each broadcast is bounded whatever
    its size; the documents aren't shuffled. With more than one set, the documents are stored between passes.
    """
    spark = docs.sparkSession
    windows = stored(_windows(benchmark, item, item_text, width), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    part = F.pmod(F.xxhash64("win", "item"), F.lit(blocks))
    base = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "hit_spans", "items", "contaminated", "hit__", "item__") or c == text]
    out = docs.select(base).withColumn("hit__", F.array().cast("array<int>")).withColumn("item__", F.array().cast("array<string>"))
    for b in range(blocks):
        by_length: dict = defaultdict(lambda: defaultdict(list))
        for row in windows.where(part == b).collect():  # about block_windows rows
            by_length[bytes(row.win).count(b" ") + 1][bytes(row.win)].append(row.item)
        tables = spark.sparkContext.broadcast({m: {k: tuple(v) for k, v in p.items()} for m, p in by_length.items()})

        def make(tables=tables):
            searches = _searches(tables)

            def one(t, hit, items):
                words = alnum_words(t)
                spans = list(zip(hit[::2], hit[1::2], strict=True))
                found = set(items)
                for s in searches:
                    for start, value in s.find(words):
                        spans.append((start, start + s.length))
                        found.update(x for x in value if x is not None)
                flat: list[int] = []
                for start, end in sorted(spans):
                    if flat and start <= flat[-1]:
                        flat[-1] = max(flat[-1], end)
                    else:
                        flat += [start, end]
                return len(words), flat, sorted(found)

            return lambda texts, hits, items: [list(c) for c in zip(*map(one, texts, hits, items), strict=True)]

        out = add_columns(out, [text, "hit__", "item__"], "n_words bigint, hit__ array<int>, item__ array<string>", make)
        if b < blocks - 1:  # so that a worker never holds the tables of two passes
            out = stored(out, "searched")
    spans = F.expr("transform(sequence(0, cast(size(hit__) / 2 as int)), i -> named_struct('start', try_element_at(hit__, 2 * i + 1), 'end', try_element_at(hit__, 2 * i + 2)))")
    out = out.withColumn("hit_spans", F.filter(spans, lambda s: s["start"].isNotNull()))
    out = out.withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (a, s) -> a + s.end - s.start)"))
    return out.withColumn("items", F.col("item__")).withColumn("contaminated", F.col("n_hit") > 0).drop("hit__", "item__")
