"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content Zstandard dictionary of its own sample texts. A text is compressed with each, in
chunks, so that the dictionary and not the text's own beginning keeps helping.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

#: Sample rows per language, and the characters of each, that a dictionary is made from: a bound on what is fitted.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 2000, 1 << 15
#: Texts are compressed in chunks of so many bytes.
CHUNK = 2048
#: A prediction is rejected when the second smallest size is not larger by this share.
MARGIN = 0.005
LEVEL = 6
_LETTER = regex.compile(r"\p{L}").search


def held_out(doc_id: str = "doc_id"):
    """The column that is true for rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: ASCII characters that aren't letters become spaces, which then are single.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _rounded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary per language from a sample of ``docs`` (already without held-out rows), bounded by ``rows`` and ``size``.

    The sample of a language is drawn by a hash of the text at a rate that its count sets, so it is the same for
    any partitioning and no group of rows is gathered. Every drawn text enters, with an equal share of ``size`` at a
    place that a hash picks; what short texts leave over goes to the others. Rows with a null language, and those whose
    text is null or has no letter, are not learned from; texts of any other length are.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, rows / n))])
    h = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    place = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    drawn = known.where(h < rate[F.col("lang")]).select("lang", F.xxhash64("text", F.lit("order")).alias("h"), F.substring(F.col("text"), (place + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    by: dict[str, list[tuple[int, bytes]]] = {}
    for r in drawn.collect():
        by.setdefault(r.lang, []).append((r.h, _rounded(r.text)))
    out = {}
    for k, texts in by.items():
        left, share = size - len(texts), {}
        for i, (h, b) in enumerate(sorted(texts, key=lambda x: (len(x[1]), x))):
            share[h, b] = min(len(b), max(left, 0) // (len(texts) - i))
            left -= share[h, b]
        parts = []
        for h, b in sorted(texts):
            n = share[h, b]
            at = h % (len(b) - n + 1)
            parts.append(b[at : at + n])
        out[k] = b"\n".join(parts)[-size:]
    for k in set(counts) - set(out):  # a language so rare, or so repeated, that the draw missed it
        r = known.where(F.col("lang") == k).orderBy(F.xxhash64("text"), "text").limit(8).collect()
        out[k] = b"\n".join(_rounded(x.text[:SAMPLE_CHARS]) for x in r)[-size:]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.coders = []
        for k in self.langs:
            d = zstd.ZstdCompressionDict(dictionaries[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> np.ndarray:
        b = _rounded(text)
        parts = [b[i : i + CHUNK] for i in range(0, len(b), CHUNK)]
        return np.array([sum([len(c(x)) for x in parts]) for c in self.coders], float)

    def __call__(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score, whether it is rejected, and the margin."""
        if not text or not self.langs or not _LETTER(text):
            return "und", 0.0, True, 0.0
        s = self.sizes(text)
        at = np.argsort(s, kind="stable")
        margin = float(s[at[1]] / s[at[0]] - 1) if len(at) > 1 else 1.0
        w = np.exp((s[at[0]] - s) / s[at[0]] * 50)
        return self.langs[at[0]], float(1 / w.sum()), margin < self.margin, margin

    margin = MARGIN


@lru_cache(maxsize=4)
def _cached(items: tuple) -> Classifier:
    return Classifier(dict(items))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (0 to 1), ``rejected`` and ``margin``.

    ``und`` with score 0, rejected, for a null text, one without letters, or if nothing was learned. Ties go to the
    first language by name and are rejected. Whole texts are used. Other columns stay; one that has the name of an
    added column is replaced. An empty table gives no rows.
    """
    items = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def make():
        c = _cached(items.value)
        c.margin = margin
        return lambda texts: [list(x) for x in zip(*map(c, texts), strict=True)]

    return add_columns(docs, [text], "lang_pred string, score double, rejected boolean, margin double", make)
