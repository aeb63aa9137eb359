"""Ordered-set, hypothetical-set and JSON aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestra.functions.numeric import guard


def percentile_disc(c: Column, fraction: float) -> Column:
    """The first value whose place reaches the fraction; any type that sorts."""
    ordered = F.array_sort(F.collect_list(c))
    return F.when(F.size(ordered) > 0, F.get(ordered, F.greatest(F.ceil(F.lit(fraction) * F.size(ordered)).cast("int"), F.lit(1)) - 1))


def percentile_cont(c: Column, *fractions: float) -> Column:
    """Linear interpolation; several fractions give an array."""
    each = [F.percentile(c.cast("double"), f) for f in fractions]
    return each[0] if len(each) == 1 else F.array(*each)


def mode(c: Column) -> Column:
    """The most frequent value, of several the least."""
    return F.mode(c, True)


def _before(c: Column, value: Column) -> Column:
    """Does c sort before value? NULLs are the largest, and equal to each other."""
    return c.isNotNull() & (value.isNull() | F.coalesce(c < value, F.lit(False)))


def modes(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the most frequent value, of several the least: counted once for each value, so no group's values meet."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    best = each.groupBy(*keys).agg(F.min(F.struct((-F.col("__c")).alias("c"), F.col(value).alias("v")))["v"].alias(name))
    return df.select(*keys).distinct().join(best, keys, "left") if keys else best


def rank_of(value: Column, c: Column) -> Column:
    """rank(value) WITHIN GROUP (ORDER BY c): NULLs are the largest values and count as rows."""
    return F.lit(1) + F.count_if(_before(c, value))


def dense_rank_of(value: Column, c: Column) -> Column:
    return F.lit(1) + F.count_distinct(F.when(_before(c, value), c))


def percent_rank_of(value: Column, c: Column) -> Column:
    n = F.count(F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(_before(c, value)) / n)


def cume_dist_of(value: Column, c: Column) -> Column:
    return (F.count_if(_before(c, value) | c.eqNullSafe(value)) + 1) / (F.count(F.lit(1)) + 1)


def group_by_key(df: DataFrame, key: list[str], dependent: dict[str, Column], *aggregates: Column) -> DataFrame:
    """GROUP BY a primary key: columns of the key's table need not be named, as the key determines them. A group
    with two values of one of them shows that the key is none, and fails with 42803."""
    held = [F.first(c).alias(n) for n, c in dependent.items()]
    alike = [F.min(c).eqNullSafe(F.max(c)).alias(f"__one_{n}") for n, c in dependent.items()]
    out = df.groupBy(*key).agg(*held, *alike, *aggregates)
    sure = {n: guard(F.col(f"__one_{n}"), F.col(n), "42803", f"column {n} must appear in the GROUP BY clause or be used in an aggregate function") for n in dependent}
    return out.withColumns(sure).drop(*(f"__one_{n}" for n in dependent))


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float | Column], kind: str = "cont") -> DataFrame:
    """keys and, by name, percentile_cont or percentile_disc of value at each fraction: a number, or a column of df
    that is one for each group (else 22023-like error). Intervals (day to second) and numbers interpolate.

    Distributed: values are counted once each, ranked by running counts, and only the ranks that a fraction asks for
    are kept; no group has to fit into one buffer. Sorting is by group and value."""
    from lodestra.operators.windows import running_counts

    named = {n: f if isinstance(f, Column) else F.lit(float(f)) for n, f in fractions.items()}
    group = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    sizes = df.groupBy(*keys).agg(F.count(value).alias("__n"), *(x for n, f in named.items() for x in (F.min(f).alias(f"__f_{n}"), F.max(f).alias(f"__g_{n}"))))
    ranked = running_counts(group, keys, value, "__c", "__upto")
    ranked = ranked.select(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)), value, "__c", "__upto")
    same = [sizes[k].eqNullSafe(ranked[f"__k_{i}"]) for i, k in enumerate(keys)]
    met = sizes.join(ranked, same, "left") if keys else sizes.crossJoin(ranked)
    low_high, outs = [], []
    for n in named:
        f = guard((F.col(f"__f_{n}") == F.col(f"__g_{n}")) & F.col(f"__f_{n}").between(0, 1), F.col(f"__f_{n}"), "22003", "percentile value must be one for each group, between 0 and 1")
        place = f * (F.col("__n") - 1) + 1 if kind == "cont" else F.greatest(F.ceil(f * F.col("__n")), F.lit(1)).cast("double")
        low, high = F.floor(place), F.ceil(place)
        holds = lambda at: (F.col("__upto") >= at) & (F.col("__upto") - F.col("__c") < at)
        low_high += [F.max(F.when(holds(low), F.col(value))).alias(f"__l_{n}"), F.max(F.when(holds(high), F.col(value))).alias(f"__h_{n}"), F.max(place - low).alias(f"__w_{n}")]
        a, b, w = F.col(f"__l_{n}"), F.col(f"__h_{n}"), F.col(f"__w_{n}")
        span = df.schema[value].dataType.typeName().startswith("interval") or "interval" in df.schema[value].dataType.simpleString()
        number = a + (b - a) * w if span else a.cast("double") + (b.cast("double") - a.cast("double")) * w
        outs.append((F.when(w == 0, a if span else a.cast("double")).otherwise(number) if kind == "cont" else a).alias(n))
    return met.groupBy(*(sizes[k] for k in keys)).agg(*low_high).select(*keys, *outs)


def json_agg(c: Column, strict: bool = False) -> Column:
    """A JSON array of the values in their order; NULLs stay as null unless strict."""
    if strict:
        return F.to_json(F.array_sort(F.collect_list(c)))
    held = F.array_sort(F.collect_list(F.struct(c.alias("v"))))
    parts = F.transform(held, lambda x: F.coalesce(F.get(F.split(F.regexp_replace(F.to_json(F.array(x["v"])), r"^\[|\]$", ""), "\u0000"), F.lit(0)), F.lit("null")))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def json_object_agg(k: Column, v: Column, *order: Column, unique: bool = False) -> Column:
    """A JSON object of all pairs, equal keys and NULL values among them, in the order of `order` or of the pairs.
    A NULL key fails with 22004; with `unique` an equal key fails with 22030."""
    pairs = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), guard(k.isNotNull(), k, "22004", "null value not allowed for object key").alias("k"), v.alias("v"))))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r"(?s)^\{\"x\":(.*)\}$", 1)
    out = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(text(p["k"].cast("string")), F.lit(":"), text(p["v"]))), ","), F.lit("}"))
    if unique:
        keys = F.transform(pairs, lambda p: p["k"])
        return guard(F.size(F.array_distinct(keys)) == F.size(keys), out, "22030", "duplicate JSON object key value")
    return out
