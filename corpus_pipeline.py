"""A corpus pipeline: quality, language, near duplicates, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of ``docs``; the last returns tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelveil.functions.tables import settled
from pixelveil.llm import decontaminate, jaccard, language, quality
from pixelveil.llm.bpe import bpe
from pixelveil.llm.common import small_or_not, stored, with_import_path

#: Ids of dropped documents that may be broadcast (8 bytes each).
MOST_BROADCAST = 2_000_000


def _named(column: str) -> Column:
    return F.col(f"`{column.replace('`', '``')}`")


def _kept(docs: DataFrame, decide: Callable[[DataFrame, list[str]], DataFrame], condition: Column) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for which ``condition`` holds on what ``decide`` adds.

    ``decide`` sees the text, and in one struct, whose name no operator adds, the other columns, so none is overwritten.
    """
    box = "row__"
    rows = docs.select("text", F.struct(*[_named(c) for c in docs.columns if c != "text"]).alias(box))
    out = decide(rows, ["text", box]).where(condition)
    return out.select(*[F.col("text") if c == "text" else F.col(box)[c].alias(c) for c in docs.columns])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from this stage's labelled input, predicts to be good.

    Null and empty texts are scored like others, rows with a null id are scored but not learned from, repeated rows are
    scored each. Without labels of both kinds the share of label 1 decides for all. An empty table gives no rows. All
    columns stay as they are, whatever their names.
    """
    labels = with_import_path(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn_from_texts(docs, labels)
    return _kept(docs, lambda rows, keep: quality.score_texts(rows, model, keep=keep), F.col("predicted") == 1)


def filter_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a sufficient margin.

    Null texts and those without letters are rejected; rows with a null language or id are told but not learned from.
    Repeated rows all stay or none does. An empty table gives no rows. All columns stay as they are, whatever their names.
    """
    model = language.fit(docs.where(~language.held_out("doc_id") & F.col("doc_id").isNotNull()))
    return _kept(docs, lambda rows, _: language.identify(rows, model), ~F.col("rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents; rows with a null id stay, and so do wordless texts.

    Of repeated rows with one id, all stay or none does. An empty table gives no rows. All columns stay as they are.
    """
    found = stored(jaccard.jaccard_components(docs.select("doc_id", "text")), "components")
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small_or_not(gone, gone.count(), MOST_BROADCAST), "doc_id", "left_anti").select(*map(_named, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows all stay or none does. An empty benchmark drops nothing, an
    empty table gives no rows. All columns stay as they are, whatever their names.
    """
    benchmark = with_import_path(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, lambda rows, _: decontaminate.decontaminate(rows, benchmark), ~F.col("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row.

    Null texts count as empty: no tokens. Repeated rows are encoded each; an empty table gives no rows. Other columns play no part.
    """
    out = bpe(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", filter_quality),
    ("language ID", filter_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: The classifier and the language model can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages, a table in the shared folder. A stage's other tables are removed when it is done."""
    docs = with_import_path(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
