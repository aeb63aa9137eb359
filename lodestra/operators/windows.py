"""Window frames that Spark lacks: GROUPS, EXCLUDE, and FILTER over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW, _HIGH = Window.unboundedPreceding, Window.unboundedFollowing


def with_groups(df: DataFrame, partition: list[str], order: list[Column], name: str = "__group") -> DataFrame:
    """df with the number of each row's peer group; GROUPS frames are RANGE frames over it."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))


def groups_between(partition: list[str], low: int, high: int, name: str = "__group"):
    return Window.partitionBy(*partition).orderBy(name).rangeBetween(low, high)


def numbered(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """df with __group, the number of each row's peer group, and __row, its place among its peers: what excluding()
    needs."""
    return with_groups(df, partition, order).withColumn("__row", F.row_number().over(Window.partitionBy(*partition, "__group").orderBy(*order)))


def excluding(value: Column, what: str, partition: list[str], fn=F.sum, low: int | None = None, high: int | None = None) -> Column:
    """fn (F.sum, F.count, F.avg, F.min or F.max) over the frame GROUPS BETWEEN low AND high (None: unbounded;
    the current row's peers lie in it), without the current row, its peer group or its ties, on a table from
    numbered(). Nothing is subtracted: the frames before and after what is left out are added, so floats and
    infinities are exact, and no row's frame is collected."""
    by = Window.partitionBy(*partition).orderBy("__group")
    peers = Window.partitionBy(*partition, "__group").orderBy("__row")
    first, last = _LOW if low is None else low, _HIGH if high is None else high
    frames = [by.rangeBetween(first, -1)] * (first < 0) + [by.rangeBetween(1, last)] * (last > 0)
    inside = [peers.rowsBetween(_LOW, -1), peers.rowsBetween(1, _HIGH)]
    frames += {"no others": [peers.rowsBetween(_LOW, _HIGH)], "current row": inside, "group": [], "ties": [peers.rowsBetween(0, 0)]}[what]

    def over(f) -> list[Column]:
        return [f(value).over(w) for w in frames]

    def total(parts: list[Column]) -> Column:
        known = [F.coalesce(p, F.lit(0)) for p in parts]
        return F.when(F.coalesce(*parts).isNotNull(), sum(known[1:], known[0]))

    if not frames:
        return F.lit(0) if fn is F.count else F.lit(None)
    if fn in (F.min, F.max):
        return over(fn)[0] if len(frames) == 1 else (F.least if fn is F.min else F.greatest)(*over(fn))
    if fn is F.avg:
        return total(over(F.sum)) / total(over(F.count))
    return total(over(fn))


def running_counts(df: DataFrame, partition: list[str], order: str, count: str, name: str) -> DataFrame:
    """df with, as `name`, the sum of `count` over (PARTITION BY partition ORDER BY order) where no two rows of a
    partition are peers. The rows are sorted into ranges by partition and order, each range sums its own, and what
    the ranges before hold of a partition is carried over, one row a range and partition: no partition has to fit
    into one task. The ranges are written to the shared folder, so that both of their readers see the same."""
    from lodestra.plans.storage import settled

    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = settled(spark, df.repartitionByRange(n, *partition, order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", *partition).orderBy(order).rowsBetween(_LOW, 0)
    before = Window.partitionBy(*partition).orderBy("__range").rowsBetween(_LOW, -1)
    totals = ranges.groupBy("__range", *partition).agg(F.sum(count).alias("__t"))
    carry = totals.select(F.col("__range").alias("__r"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(partition)), F.sum("__t").over(before).alias("__before")).where("__before is not null")
    mine = ranges.withColumn(name, F.sum(count).over(inside))
    same = [mine["__range"] == carry["__r"], *(mine[k].eqNullSafe(carry[f"__k{i}"]) for i, k in enumerate(partition))]
    out = mine.join(carry, same, "left").withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0)))
    return out.select(*df.columns, name)


def filtered(fn, value: Column, condition: Column, frame) -> Column:
    """fn(value) FILTER (WHERE condition) OVER frame"""
    return fn(F.when(condition, value)).over(frame)


def range_sum(df: DataFrame, partition: list[str], order: str, low: int, high: int, value: Column, name: str) -> DataFrame:
    """df with the sum of value over (PARTITION BY partition ORDER BY order RANGE BETWEEN low AND high), order a
    column of whole numbers: summed once for each of its values and given to the values in whose frame it lies, so
    that no partition's rows have to meet in one task. The frame of a null is its peers."""
    kind = df.schema[order].dataType
    per = df.groupBy(*partition, order).agg(F.sum(value).alias("__s"))
    frames = F.when(F.col(order).isNull(), F.array(F.lit(None).cast(kind))).otherwise(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda d: (F.col(order) - d).cast(kind)))
    keys = [*partition, order]
    given = per.select(*partition, F.explode(frames).alias(order), "__s").groupBy(*keys).agg(F.sum("__s").alias(name))
    given = given.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), name)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(given, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))
