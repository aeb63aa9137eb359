"""Runs a registered query and its DuckDB twin over one folder and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import numpy as np

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(x):
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, (int, np.integer)):
        return float(f"{int(x):.9g}") if abs(int(x)) > 2**53 else int(x)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, datetime.date) else bytes(x) if isinstance(x, (bytearray, memoryview)) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    loose = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in out]
    return sorted(names), sorted(loose, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """'' if the rows are the same, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows and {len(theirs[1])}"
    for a, b in zip(*(x[1] for x in (mine, theirs))):
        if a != b:
            return f"{a} and {b}"
    return ""
