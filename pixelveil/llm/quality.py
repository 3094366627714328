"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over all labelled rows, added up by Spark. Each covariance is shrunk
towards the pooled one and then towards its diagonal; its Cholesky factor is kept. The score is the posterior
of label 1 from the difference of Mahalanobis log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, add_columns, small_or_not, stored

STATISTICS = ["chars", "words", "word_length", "upper", "digits", "symbols", "marks", "spaces", "distinct_words", "repeated_lines", "line_length", "long_words", "symbol_words", "no_letters"]
#: Shrinkage towards the pooled covariance and towards the diagonal, and a floor for variances.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.1, 0.1, 1e-4
#: Tempering of the log-density difference, which features that depend on each other exaggerate.
TEMPER = 0.5
THRESHOLD = 0.3
#: Labelled ids that may be broadcast (12 bytes each).
MOST_BROADCAST = 2_000_000
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_MARK = np.array([chr(b) in ".,;:?'\"()-" for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_SYMBOL = ~(_DIGIT | _SPACE | _MARK | _LETTER)
_CLASSES = np.stack([_UPPER, _DIGIT, _SPACE, _MARK, _LETTER, _SYMBOL]).astype(float).T
_SYMBOLS = frozenset(chr(b).encode() for b in range(128) if _SYMBOL[b])


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; all finite, also for a null or empty one."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = len(b)
    upper, digit, space, mark, letter, symbol = (np.bincount(np.frombuffer(b, np.uint8), minlength=256) @ _CLASSES).tolist()
    words = b.translate(LOWER).split()
    k = len(words)
    lines = [x for x in b.split(b"\n") if x]
    share = lambda x, of: (x + 0.5) / (of + 1.0)
    logit = lambda x, of: float(np.log(share(x, of) / max(1e-9, 1 - share(min(x, of), of + 0.5))))
    distinct = len(set(words))
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        float(np.log1p((n - space) / (k + 1.0))),
        logit(upper, letter),
        logit(digit, n),
        logit(symbol, n),
        logit(mark, n),
        logit(space, n),
        float(np.log1p(distinct) / np.log1p(k)) if k else 1.0,
        logit(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / (len(lines) + 1.0))),
        logit(sum([len(w) > 20 for w in words]), k),
        logit(sum([w[-1:] in _SYMBOLS for w in words]), k),
        logit(n - letter - space, n),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``stats``, an array of ``STATISTICS``; an input column of that name is replaced."""
    return add_columns(docs, [text], "stats array<double>", lambda: lambda texts: [[statistics(t) for t in texts]])


def held_out(doc_id: str = "doc_id"):
    """The column that is true for rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Discriminant:
    """Log prior, mean and Cholesky factor by class, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    log_prior: np.ndarray
    means: np.ndarray
    factors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 by row."""
        z = np.clip((x - self.centre) / self.scale, -30, 30)
        logs = []
        for prior, mean, factor in zip(self.log_prior, self.means, self.factors, strict=True):
            y = np.linalg.solve(factor, (z - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (y * y).sum(0))
        return 1 / (1 + np.exp(-np.clip(TEMPER * (logs[1] - logs[0]), -50, 50)))


def fit(labelled: DataFrame, label: str = "quality") -> Discriminant | float:
    """From rows with ``stats`` and a label 0 or 1 (already without held-out rows); other labels and nulls are left out.

    Every row counts, repeated ones too. If a class has no rows, the share of label 1 is returned instead (0.5 without rows).
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    s = lambda i: F.col("stats")[i]
    sums = labelled.where(F.col(label).isin(0, 1) & F.col("stats").isNotNull()).groupBy(F.col(label).alias("k")).agg(F.count("*").alias("n"), *[F.sum(s(i)).alias(f"s{i}") for i in range(d)], *[F.sum(s(i) * s(j)).alias(f"p{i}_{j}") for i, j in pairs])
    by = {r.k: r for r in sums.collect()}
    if set(by) != {0, 1}:
        return 1.0 if 1 in by else 0.0 if 0 in by else 0.5
    n = np.array([by[k].n for k in (0, 1)], float)
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        means[k] = [by[k][f"s{i}"] / n[k] for i in range(d)]
        for i, j in pairs:
            covs[k, i, j] = covs[k, j, i] = by[k][f"p{i}_{j}"] / n[k] - means[k, i] * means[k, j]
    centre = (n @ means) / n.sum()
    pooled = np.tensordot(n, covs, 1) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), FLOOR))
    means, covs, pooled = (means - centre) / scale, covs / np.outer(scale, scale), pooled / np.outer(scale, scale)
    factors = []
    for k in (0, 1):
        few = d / (d + n[k])
        c = (1 - max(TO_POOLED, few)) * covs[k] + max(TO_POOLED, few) * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + 0.02 * np.eye(d)
        factors.append(np.linalg.cholesky(c))
    return Discriminant(centre, scale, np.log(n / n.sum()), means, np.array(factors))


def score(df: DataFrame, model: Discriminant | float, threshold: float = THRESHOLD) -> DataFrame:
    """Every row that has ``stats`` with ``score`` (0 to 1, of label 1) and ``predicted`` (1 if score >= threshold)."""

    def make():
        def f(stats):
            x = np.array(stats, float).reshape(-1, len(STATISTICS))
            s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            return [s.tolist(), (s >= threshold).astype(int).tolist()]

        return f

    return add_columns(df, ["stats"], "score double, predicted int", make)


def score_texts(docs: DataFrame, model: Discriminant | float, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Every row with ``stats``, ``score`` and ``predicted`` in one pass; other columns stay, or only those of ``keep``.

    A null text is scored as an empty one. Columns with the names of added ones are replaced. An empty table gives no rows.
    """

    def make():
        def f(texts):
            stats = [statistics(t) for t in texts]
            x = np.array(stats, float).reshape(-1, len(STATISTICS))
            s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            return [stats, s.tolist(), (s >= threshold).astype(int).tolist()]

        return f

    return add_columns(docs, [text], "stats array<double>, score double, predicted int", make, keep)


def learn(narrow: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Discriminant | float:
    """The model from ``narrow`` (id and ``stats``) and labelled rows that aren't held out; null ids and labels are left out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("k")).where(F.col("k").isNotNull())
    rows = narrow.select(F.col(doc_id).alias("id"), "stats").where(~held_out("id"))
    return fit(rows.join(known, "id"), "k")


def learn_from_texts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Discriminant | float:
    """``learn``, but statistics are made of labelled texts alone, which meet their ids by broadcast where these are few."""
    known = stored(labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("k")).where(F.col("k").isNotNull() & F.col("id").isNotNull()), "labels")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(~held_out("id"))
    met = rows.join(small_or_not(known, known.count(), MOST_BROADCAST), "id")
    return fit(with_statistics(met).select("stats", "k"), "k")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Every row of ``docs`` with ``stats``, ``held_out``, ``score`` and ``predicted``.

    Learned from labelled rows that aren't held out, joined by id; rows with a null id are scored but not learned
    from. Neither labels nor other columns than the text enter a score. A null text is scored as an empty one. With
    no labels or one class only, the score is the share of label 1. Columns with the names of added ones are
    replaced. An empty table gives no rows.
    """
    model = learn_from_texts(docs, labels, doc_id, text, label)
    return score_texts(docs, model, text).withColumn("held_out", held_out(doc_id))
