"""Plans and statistics as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explain_rows(df: DataFrame) -> DataFrame:
    """(depth, node, detail) for each operator of the physical plan, from the top down."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    rows = []
    for line in text.splitlines():
        m = re.match(r"^([\s:|+\-]*)(?:\*\(\d+\)\s*)?([A-Za-z]\w*)\s*(.*)$", line)
        if m:
            rows.append((len(m[1]) // 3, m[2], m[3].strip()))
    return df.sparkSession.createDataFrame(rows, "depth int, node string, detail string")


def column_statistics(df: DataFrame, *columns: str, buckets: int = 10) -> DataFrame:
    """One row a column: rows, NULLs, estimated distinct values, least, largest, and quantile bounds of
    numbers. One pass over the table for all columns."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    names = list(columns or df.columns)
    numeric = {c for c in names if re.match("tinyint|smallint|int|bigint|float|double|decimal", kinds[c])}
    parts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        parts += [F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.approx_count_distinct(c).alias(f"d{i}"), F.min(F.col(c)).cast("string").alias(f"l{i}"), F.max(F.col(c)).cast("string").alias(f"h{i}")]
        if c in numeric:
            parts.append(F.percentile_approx(F.col(c).cast("double"), [k / buckets for k in range(buckets + 1)], 1000).alias(f"q{i}"))
    row = df.agg(*parts).first()
    out = [(c, row["n"], row[f"z{i}"], row[f"d{i}"], row[f"l{i}"], row[f"h{i}"], list(row[f"q{i}"]) if c in numeric and row[f"q{i}"] else None) for i, c in enumerate(names)]
    return spark.createDataFrame(out, "column_name string, n_rows bigint, n_nulls bigint, n_distinct bigint, least string, largest string, bounds array<double>")


def common_values(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most common values and their shares of all rows."""
    n = df.count()
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col(column).isNotNull())
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(top).select(column, "n", (F.col("n") / max(n, 1)).alias("share"))
