"""Result sinks: files for whole results, and text renderings of at most `limit` rows."""

from __future__ import annotations

import csv as _csv
import io
import json

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)


def dump(df: DataFrame, path: str, name: str) -> str:
    """A logical dump: the rows as Parquet and the statement that declares the table."""
    df.write.parquet(path)
    columns = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{path}'"


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _cells(df: DataFrame, limit: int | None, null: str) -> list[list[str]]:
    show = lambda x: null if x is None else {True: "true", False: "false"}.get(x, str(x)) if isinstance(x, bool) else str(x)
    return [[show(x) for x in row] for row in _first(df, limit).toLocalIterator()]


def _widths(names: list[str], rows: list[list[str]]) -> list[int]:
    return [max(map(len, column)) for column in zip(names, *rows)]


def aligned(df: DataFrame, limit: int | None = None, null: str = "") -> str:
    """All rows, or `limit` of them; the last line says if there are more."""
    rows = _cells(df, None if limit is None else limit + 1, null)
    rows, more = rows[:limit], ", stopped" if limit is not None and len(rows) > limit else ""
    w = _widths(df.columns, rows)
    line = lambda r: " | ".join(x.ljust(n) for x, n in zip(r, w)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * n for n in w), *map(line, rows), f"({len(rows)} row{'' if len(rows) == 1 else 's'}{more})"])


def box(df: DataFrame, limit: int | None = None, null: str = "") -> str:
    rows = _cells(df, limit, null)
    w = _widths(df.columns, rows)
    rule = lambda a, b, c: a + b.join("─" * (n + 2) for n in w) + c
    line = lambda r: "│" + "│".join(f" {x.ljust(n)} " for x, n in zip(r, w)) + "│"
    return "\n".join([rule("┌", "┬", "┐"), line(df.columns), rule("├", "┼", "┤"), *map(line, rows), rule("└", "┴", "┘")])


def markdown(df: DataFrame, limit: int | None = None, null: str = "") -> str:
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in r) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, _cells(df, limit, null))])


def csv_text(df: DataFrame, limit: int | None = None) -> str:
    out = io.StringIO()
    writer = _csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(_cells(df, limit, ""))
    return out.getvalue()


def json_text(df: DataFrame, limit: int | None = None) -> str:
    return json.dumps([json.loads(x) for x in _first(df, limit).toJSON().toLocalIterator()], ensure_ascii=False)
