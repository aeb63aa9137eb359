"""The corpus pipeline: five operators in a row over the documents of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestra.llm import stages

STAGES = stages.STAGES
#: Several stages (trained models, near-duplicate search, tokenizer) have no SQL form; tests hold the
#: pipeline against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stages.written(spark, stage(spark, docs, sf_dir)) if name != STAGES[-1][0] else stage(spark, docs, sf_dir)
    return docs
