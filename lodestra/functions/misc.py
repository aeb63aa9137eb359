"""Identifiers, sequences, settings and NULL counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestra.plans.storage import settled


def uuid_version(u: Column) -> Column:
    return F.when(F.substring(u, 20, 1).isin("8", "9", "a", "b"), F.conv(F.substring(u, 15, 1), 16, 10).cast("smallint"))


def uuid_timestamp(u: Column) -> Column:
    millis = F.conv(F.replace(F.substring(u, 1, 13), F.lit("-"), F.lit("")), 16, 10).cast("bigint")
    return F.when(uuid_version(u) == 7, F.timestamp_millis(millis))


def uuidv4() -> Column:
    return F.expr("uuid()")


def uuidv7(at: Column | None = None) -> Column:
    """Time-ordered: 48 bits of milliseconds in front of random ones."""
    h = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp() if at is None else at)), 12, "0"))
    u = F.expr("uuid()")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-7"), F.substring(u, 16, 21))


def num_nulls(*columns: Column) -> Column:
    return sum((c.isNull().cast("int") for c in columns), F.lit(0))


def num_nonnulls(*columns: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))


class Sequence:
    """A counter of the session. Rows get numbers by their place in an order, in one block per call."""

    def __init__(self, start: int = 1, step: int = 1):
        self.next, self.step, self.last = start, step, None

    def nextval(self) -> int:
        self.last = self.next
        self.next += self.step
        return self.last

    def currval(self) -> int:
        """The value that nextval() gave last here."""
        if self.last is None:
            raise ValueError("[55000] currval is not yet defined in this session")
        return self.last

    def setval(self, value: int, called: bool = True) -> int:
        self.last, self.next = value, value + self.step if called else value
        return value

    def number(self, df: DataFrame, name: str, *order: Column) -> DataFrame:
        """df with a number for each row. Rows are ranked range by range: only counts per range meet."""
        ordered = df.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        ordered = ordered.withColumn("__row", F.col("__at") - F.shiftleft(F.col("__part").cast("bigint"), 33))
        ordered = settled(df.sparkSession, ordered)  # counted and numbered from one and the same sort
        sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
        before, total = {}, 0
        for r in sorted(sizes.collect(), key=lambda r: r["__part"]):
            before[r["__part"]], total = total, total + r["n"]
        base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__part")] if before else F.lit(0)
        start = self.next
        self.next += total * self.step
        self.last = self.next - self.step if total else self.last
        return ordered.withColumn(name, F.lit(start) + (base + F.col("__row")) * self.step).drop("__part", "__at", "__row")


class Settings(dict):
    """Session variables; a missing one is an error unless allowed."""

    def current(self, name: str, missing_ok: bool = False) -> Column:
        if name not in self and not missing_ok:
            raise KeyError(f"[42704] unrecognized configuration parameter {name!r}")
        return F.lit(self.get(name))
