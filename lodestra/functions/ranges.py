"""Ranges as structs of lower, upper, lower_inc, upper_inc and empty; a NULL bound is infinite.

Discrete ranges (with a step) are kept in the form [lower, upper)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestra.functions.numeric import guard


def make(lower: Column, upper: Column, bounds: str = "[)", step: Callable[[Column], Column] | None = None) -> Column:
    li, ui = F.lit(bounds[0] == "[") & lower.isNotNull(), F.lit(bounds[1] == "]") & upper.isNotNull()
    if step is not None:
        lower, li = F.when(~li & lower.isNotNull(), step(lower)).otherwise(lower), lower.isNotNull()
        upper, ui = F.when(ui, step(upper)).otherwise(upper), F.lit(False)
    empty = F.coalesce((lower > upper) | ((lower == upper) & ~(li & ui)), F.lit(False))
    made = F.struct(F.when(~empty, lower).alias("lower"), F.when(~empty, upper).alias("upper"), (li & ~empty).alias("lower_inc"), (ui & ~empty).alias("upper_inc"), empty.alias("empty"))
    return made if step is not None else guard(F.coalesce(lower <= upper, F.lit(True)), made, "22000", "lower bound above upper bound")


def i64range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower.cast("bigint"), upper.cast("bigint"), bounds, lambda c: c + F.lit(1).cast("bigint"))


def i32range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower.cast("int"), upper.cast("int"), bounds, lambda c: c + F.lit(1))


def daterange(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower.cast("date"), upper.cast("date"), bounds, lambda c: F.date_add(c, 1))


def numrange(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower, upper, bounds)


tsrange = tstzrange = numrange


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def _starts_le(a: Column, b: Column) -> Column:
    """a begins no later than b."""
    return a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))


def _ends_ge(a: Column, b: Column) -> Column:
    """a ends no earlier than b."""
    return a["upper"].isNull() | (b["upper"].isNotNull() & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))


def _ends_before(a: Column, b: Column) -> Column:
    """a ends before b begins."""
    return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def contains(a: Column, b: Column) -> Column:
    return b["empty"] | (~a["empty"] & F.coalesce(_starts_le(a, b) & _ends_ge(a, b), F.lit(False)))


def contains_value(r: Column, v: Column) -> Column:
    low = r["lower"].isNull() | (v > r["lower"]) | ((v == r["lower"]) & r["lower_inc"])
    high = r["upper"].isNull() | (v < r["upper"]) | ((v == r["upper"]) & r["upper_inc"])
    return ~r["empty"] & low & high


def overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~_ends_before(a, b) & ~_ends_before(b, a)


def strictly_left(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & _ends_before(a, b)


def strictly_right(a: Column, b: Column) -> Column:
    return strictly_left(b, a)


def not_extend_right(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & F.coalesce(_ends_ge(b, a), F.lit(False))


def not_extend_left(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & F.coalesce(_starts_le(b, a), F.lit(False))


def adjacent(a: Column, b: Column) -> Column:
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def _build(low: Column, high: Column) -> Column:
    return F.struct(low["lower"].alias("lower"), high["upper"].alias("upper"), low["lower_inc"].alias("lower_inc"), high["upper_inc"].alias("upper_inc"), F.lit(False).alias("empty"))


def _pick(test: Column, a: Column, b: Column) -> Column:
    return F.when(test, a).otherwise(b)


def merge(a: Column, b: Column) -> Column:
    """The least range that holds both."""
    both = _build(_pick(F.coalesce(_starts_le(a, b), F.lit(False)), a, b), _pick(F.coalesce(_ends_ge(a, b), F.lit(False)), a, b))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(both)


def union(a: Column, b: Column) -> Column:
    ok = a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b)
    return guard(ok, merge(a, b), "22000", "result of range union would not be contiguous")


def empty_like(r: Column) -> Column:
    return F.struct(F.nullif(r["lower"], r["lower"]).alias("lower"), F.nullif(r["upper"], r["upper"]).alias("upper"), F.lit(False).alias("lower_inc"), F.lit(False).alias("upper_inc"), F.lit(True).alias("empty"))


def intersection(a: Column, b: Column) -> Column:
    both = _build(_pick(F.coalesce(_starts_le(a, b), F.lit(False)), b, a), _pick(F.coalesce(_ends_ge(a, b), F.lit(False)), b, a))
    return F.when(overlaps(a, b), both).otherwise(empty_like(a))


def difference(a: Column, b: Column) -> Column:
    """a without b; an error if that leaves two pieces."""
    left_stays = ~F.coalesce(_starts_le(b, a), F.lit(False))
    right_stays = ~F.coalesce(_ends_ge(b, a), F.lit(False))
    head = F.struct(a["lower"].alias("lower"), b["lower"].alias("upper"), a["lower_inc"].alias("lower_inc"), (~b["lower_inc"]).alias("upper_inc"), F.lit(False).alias("empty"))
    tail = F.struct(b["upper"].alias("lower"), a["upper"].alias("upper"), (~b["upper_inc"]).alias("lower_inc"), a["upper_inc"].alias("upper_inc"), F.lit(False).alias("empty"))
    cut = F.when(left_stays, head).when(right_stays, tail).otherwise(empty_like(a))
    return F.when(~overlaps(a, b), a).otherwise(guard(~(left_stays & right_stays), cut, "22000", "result of range difference would not be contiguous"))


def text(r: Column) -> Column:
    form = F.concat(F.when(r["lower_inc"], F.lit("[")).otherwise(F.lit("(")), F.coalesce(r["lower"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["upper"].cast("string"), F.lit("")), F.when(r["upper_inc"], F.lit("]")).otherwise(F.lit(")")))
    return F.when(r["empty"], F.lit("empty")).otherwise(form)
