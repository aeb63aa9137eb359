"""The thin queries op1_... to op10_... over the tables of a folder, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestra.llm import decontamination, fingerprints, language_id, line_dedup, near_dedup, quality_net, revisits, sentencepieces, substring_dedup, token_counts
from lodestra.llm.common import settled, table
from lodestra.llm.sql import ORACLE_SQL  # noqa: F401

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and for documents whose id is divisible by 100 the classes of equal fingerprints
    within NEAR_RADIUS bits (near, its own class first) and the number of the other ones (n_near); both are null for
    the rest. The matching documents are the rows that have a class's fingerprint."""
    found = settled(spark, fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")))
    asks = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    asked = found.where(asks)
    near = fingerprints.near_classes(asked, found)
    seen = asked.join(near, asked["fingerprint"] == near["query"], "left").select(*(asked[c] for c in found.columns), (F.size("near") - 1).cast("bigint").alias("n_near"), "near")
    return seen.unionByName(found.where(~asks), allowMissingColumns=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.page_records(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"])), "; ")
    return found.select("record_id", "url_key", "source_id", "source_ts", "state", "digest", merged.alias("headers"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(4, 2)
    model = language_id.fit(docs.select("doc_id", "text", "lang").where(~out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "langs", "shares")


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(5, 0)
    labels = table(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("quality").alias("label"))
    net = quality_net.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    return quality_net.score(docs, net).select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_decontamination, op3_substring_dedup, op4_revisits, op5_line_dedup, op6_near_dedup, op7_language_id, op8_quality_net, op9_sentencepieces, op10_token_counts)
}
