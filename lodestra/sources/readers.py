"""Tables from files: Parquet, CSV and JSON with a declared schema, inline rows, and folders as namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """RFC 4180 files; a bad value or a row of the wrong length is an error. An empty cell is NULL."""
    return spark.read.csv(path, schema=schema, header=header, quote='"', escape='"', multiLine=True, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def attach(spark: SparkSession, folder: str, namespace: str = "", tables: list[str] | None = None) -> list[str]:
    """The folder's tables as views, <namespace>_<table> if a namespace is given. Reading is lazy."""
    made = []
    for name in tables or TABLES:
        view = f"{namespace}_{name}" if namespace else name
        parquet(spark, folder, name).createOrReplaceTempView(view)
        made.append(view)
    return made


def detach(spark: SparkSession, views: list[str]) -> None:
    for view in views:
        spark.catalog.dropTempView(view)
