"""Read-only relations about the session's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sys_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, kind string, temporary boolean")


def sys_columns(spark: SparkSession, *tables: str) -> DataFrame:
    names = tables or tuple(t.name for t in spark.catalog.listTables())
    rows = [(t, i + 1, f.name, f.dataType.simpleString(), f.nullable) for t in names for i, f in enumerate(spark.table(t).schema)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean")


def sys_constraints(spark: SparkSession, declared: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Constraints that the caller declared: table to (kind, definition); nothing here enforces them."""
    rows = [(t, kind, text) for t, many in sorted(declared.items()) for kind, text in many]
    return spark.createDataFrame(rows, "table_name string, kind string, definition string")
