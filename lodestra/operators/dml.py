"""Statements that change a table, as functions from its old rows to its new rows (copy on write)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestra.functions.numeric import guard


@dataclass
class Change:
    """The table after a statement, and the rows that RETURNING gives."""

    table: DataFrame
    returning: DataFrame


def _aligned(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    kinds, defaults = dict(table.dtypes), defaults or {}
    return rows.select(*((F.col(c) if c in rows.columns else defaults.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in table.columns))


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> Change:
    new = _aligned(table, rows, defaults)
    return Change(table.unionByName(new), new)


def insert_on_conflict(table: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None = None, where: Column | None = None) -> Change:
    """ON CONFLICT (keys) DO NOTHING, or DO UPDATE SET. In `update` and `where` the columns of the proposed
    row are named excluded_<column>. NULL keys conflict with nothing. Of several proposed rows with one key DO
    NOTHING takes the first, in their order in `rows`; DO UPDATE may not touch a row twice and fails with 21000."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    turn = Window.partitionBy(*keys).orderBy("__at")
    new = _aligned(table, rows).withColumn("__at", F.monotonically_increasing_id())
    new = new.withColumn("__turn", F.when(known, F.row_number().over(turn)).otherwise(1))
    if update is None:
        fresh = new.where("__turn = 1").select(*table.columns).join(table.select(*keys), keys, "left_anti").select(*table.columns)
        return Change(table.unionByName(fresh), fresh)
    once = guard(F.col("__turn") == 1, F.col(keys[0]), "21000", "ON CONFLICT DO UPDATE command cannot affect row a second time")
    new = new.withColumn(keys[0], once).select(*table.columns)
    fresh = new.join(table.select(*keys), keys, "left_anti").select(*table.columns)
    proposed = new.select(*(F.col(c).alias(f"excluded_{c}") for c in new.columns), F.lit(True).alias("__hit"))
    met = table.join(proposed, [table[k] == proposed[f"excluded_{k}"] for k in keys], "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False)) & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    changed = met.select(*(F.when(hit, update[c]).otherwise(F.col(c)).cast(dict(table.dtypes)[c]).alias(c) if c in update else F.col(c) for c in table.columns), hit.alias("__new"))
    out = changed.drop("__new").unionByName(fresh)
    return Change(out, changed.where("__new").drop("__new").unionByName(fresh))


def update(table: DataFrame, assignments: dict[str, Column], where: Column | None = None) -> Change:
    """UPDATE: all assignments see the old row. RETURNING gives the new values and, as old_<column>, the old."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    kinds = dict(table.dtypes)
    both = table.select(*(F.when(hit, assignments[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in assignments else F.col(c) for c in table.columns), *(F.col(c).alias(f"old_{c}") for c in assignments), hit.alias("__hit"))
    return Change(both.select(*table.columns), both.where("__hit").drop("__hit"))


def delete(table: DataFrame, where: Column | None = None) -> Change:
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return Change(table.where(~hit), table.where(hit))


def violations_unique(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; NULLs differ from each other."""
    known = table.where(" and ".join(f"`{k}` is not null" for k in keys))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")


def violations_check(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a CHECK is false (unknown passes)."""
    return table.where(~condition)


def violations_not_null(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.where(" or ".join(f"`{c}` is null" for c in columns))


def violations_foreign_key(table: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return table.where(F.col(column).isNotNull()).join(parent, table[column] == parent[key], "left_anti")
