"""Joins on ranges and arrays as equi-joins, so they are dealt by key at every size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, a_low: str, a_high: str, b_low: str, b_high: str, width: int) -> DataFrame:
    """Pairs whose half-open ranges of whole numbers overlap. Both sides are cut into bins of `width`; a pair meets
    in several bins and is kept in the one that holds the later of the two lower bounds."""

    def binned(df: DataFrame, low: str, high: str) -> DataFrame:
        first, last = F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)
        return df.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(F.sequence(first, last)))

    met = binned(a, a_low, a_high).join(binned(b, b_low, b_high), "__bin")
    kept = (F.col(a_low) < F.col(b_high)) & (F.col(b_low) < F.col(a_high)) & (F.col("__bin") == F.floor(F.greatest(a_low, b_low) / width))
    return met.where(kept).drop("__bin")


def containment_classes(a: DataFrame, b: DataFrame, a_array: str, b_array: str) -> DataFrame:
    """ax and bx, sorted distinct arrays: each array of a beside each non-empty array of b that it holds. Only
    distinct arrays meet, and each of b's by its rarest element alone. Null elements are held by nothing."""
    left = a.select(F.array_sort(F.array_distinct(a_array)).alias("ax")).distinct()
    right = b.select(F.array_sort(F.array_distinct(b_array)).alias("bx")).distinct().where(~F.exists("bx", F.isnull))
    held = left.select("ax", F.explode("ax").alias("__e"))
    often = held.groupBy("__e").agg(F.count(F.lit(1)).alias("__c"))
    rarest = right.select("bx", F.explode("bx").alias("__e")).join(often, "__e", "left").groupBy("bx").agg(F.min(F.struct(F.coalesce("__c", F.lit(0)), "__e"))["__e"].alias("__e"))
    return held.join(rarest, "__e").where(F.size(F.array_except("bx", "ax")) == 0).select("ax", "bx")


def containment_join(a: DataFrame, b: DataFrame, a_key: str, a_array: str, b_key: str, b_array: str) -> DataFrame:
    """Keys of the pairs where a's array holds all elements of b's non-empty array: the members of the pairs of
    distinct arrays. Rows are made for pairs of the result only."""
    left = a.select(a_key, F.array_sort(F.array_distinct(a_array)).alias("ax"))
    right = b.select(b_key, F.array_sort(F.array_distinct(b_array)).alias("bx"))
    return left.join(containment_classes(a, b, a_array, b_array), "ax").join(right, "bx").select(a_key, b_key)


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """On all columns of one name; a product if there are none."""
    common = [c for c in a.columns if c in b.columns]
    return a.join(b, common, how) if common else a.crossJoin(b)


def compared(outer: DataFrame, inner: DataFrame, x: str, op: str, y: str, how: str) -> DataFrame:
    """outer rows for which `x op ANY (select y from inner)` or `... ALL ...` holds. = ANY is a semi join; all else is
    decided by one row: inner's least and largest y and whether any is null. For = ALL both must be x; for <> ANY one
    of them must not be. <> ALL is an anti join, empty as soon as inner holds a null."""
    every = {"any": False, "all": True}[how]
    if op == "=" and not every:
        ys = inner.select(F.col(y).alias("__y")).distinct()
        return outer.join(ys, outer[x] == ys["__y"], "left_semi")
    if op in ("=", "<>"):
        bound = F.broadcast(inner.agg(F.min(y).alias("__lo"), F.max(y).alias("__hi"), F.count(F.lit(1)).alias("__n"), F.count(y).alias("__known")))
        full = (F.col("__n") == 0) | (F.col("__n") == F.col("__known"))
        if op == "=":
            return outer.join(bound, (F.col("__n") == 0) | full & (F.col(x) == F.col("__lo")) & (F.col(x) == F.col("__hi")), "left_semi")
        if not every:
            return outer.join(bound, (F.col(x) != F.col("__lo")) | (F.col(x) != F.col("__hi")), "left_semi")
        ys = inner.select(F.col(y).alias("__y")).distinct()
        kept = outer.join(bound, full & ((F.col("__n") == 0) | F.col(x).isNotNull()), "left_semi")
        return kept.join(ys, kept[x] == ys["__y"], "left_anti")
    least = {"<": every, "<=": every, ">": not every, ">=": not every}[op]  # the y that is hardest, or for ANY easiest, to meet
    bound = inner.agg((F.min if least else F.max)(y).alias("__y"), F.count(F.lit(1)).alias("__n"), F.count(y).alias("__known"))
    holds = F.expr(f"`{x}` {op} __y")
    if every:
        holds = (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & holds)
    return outer.join(F.broadcast(bound), holds, "left_semi")
