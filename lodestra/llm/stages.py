"""The stages of the corpus pipeline. Each gets the documents its predecessor kept, works on all of them,
and returns what it keeps, with the columns of documents (the last adds the pieces)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestra.llm import decontamination, language_id, line_dedup, near_dedup, sentencepieces
from lodestra.llm.common import settled, table

#: A document must be this much of its main language, by proportion, to stay.
MAIN_LANGUAGE = 0.5
PIECES = "piece_bpe_32k.model"


def _others(docs: DataFrame, *but: str) -> list[str]:
    return [c for c in docs.columns if c.lower() not in ("doc_id", "text", *but)]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a main language, go. The model is fitted on the input's own labels."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model, carry=["text", *_others(docs)])
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MAIN_LANGUAGE))
    return kept.select(*(F.col(c) if c == "doc_id" else F.col(f"__c_{c}").alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in the last of them only; n_chars follows the text."""
    done = line_dedup.line_dedup(docs, carry=_others(docs, "n_chars"))
    kinds = dict(docs.dtypes)
    new = {"n_chars": F.char_length("text")}
    return done.select(*(new.get(c.lower(), F.col(f"`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that of the least doc_id, text and row."""
    return near_dedup.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a few edits, go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as SentencePiece ids, decoded again to see that nothing is lost."""
    return sentencepieces.round_trip(docs, public_tokenizers.path(PIECES), keep_pieces=True, keep_columns=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", languages),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("SentencePiece encoding and decoding", pieces),
]


def written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The stage's rows as Parquet in the shared folder, read again."""
    return settled(spark, docs)
