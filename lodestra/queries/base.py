"""Short forms for registering queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestra import registry
from lodestra.sources.readers import TABLES, parquet

_WORDS = re.compile(r"[a-z_]+")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over the tables of a folder; only the tables that it names are opened."""
    for name in set(_WORDS.findall(text)) & set(TABLES):
        parquet(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def same(name: str, text: str) -> None:
    """A query whose SQL both engines read alike."""
    both(name, text, text)


def both(name: str, spark_text: str, oracle: str) -> None:
    registry.query(name, oracle)(lambda spark, sf_dir: run_sql(spark, sf_dir, spark_text))

