"""Set-returning functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestra.functions import jsons


def generate_series(low: Column, high: Column, step: int = 1) -> Column:
    """The numbers low, low + step .. up to high, as an array; none if the direction is wrong."""
    if step == 0:
        raise ValueError("[22023] step size cannot equal zero")
    ok = (low <= high) if step > 0 else (low >= high)
    return F.when(ok, F.sequence(low, high, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def unnest(df: DataFrame, array: Column, name: str, ordinality: str | None = None) -> DataFrame:
    """One row an element; NULL and empty arrays give none."""
    if ordinality is None:
        return df.withColumn(name, F.explode(array))
    return df.select("*", F.posexplode(array).alias("__pos", name)).withColumn(ordinality, F.col("__pos") + 1).drop("__pos")


def json_array_elements(df: DataFrame, j: Column, name: str, text: bool = False) -> DataFrame:
    if text:
        return df.withColumn(name, F.explode(F.from_json(j, "array<string>")))
    return df.withColumn(name, F.explode(F.transform(F.from_json(j, "array<variant>"), lambda v: F.to_json(v))))


def json_path_query(df: DataFrame, j: Column, path: str, name: str) -> DataFrame:
    """A row for each item that a JSON path finds."""
    return df.withColumn(name, F.explode(jsons.path_query(j, path)))


def json_object_keys(df: DataFrame, j: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.json_object_keys(j)))


def json_each_text(df: DataFrame, j: Column, key: str = "key", value: str = "value") -> DataFrame:
    return df.select("*", F.explode(F.from_json(j, "map<string,string>")).alias(key, value))


def json_to_record(df: DataFrame, j: Column, schema: str, name: str = "record") -> DataFrame:
    return df.withColumn(name, F.from_json(j, schema))


def json_to_recordset(df: DataFrame, j: Column, schema: str) -> DataFrame:
    return df.select("*", F.inline(F.from_json(j, f"array<struct<{schema}>>")))


def json_populate(base: Column, j: Column, schema: str) -> Column:
    """A record with the members of j where j has them, else with the base's fields."""
    new = F.from_json(j, schema)
    names = [x.split(":")[0].split()[0].strip("` ") for x in schema.split(",")]
    return F.struct(*[F.when(F.array_contains(F.json_object_keys(j), F.lit(n)), new[n]).otherwise(base[n]).alias(n) for n in names])


def json_table(df: DataFrame, j: Column, path: str, columns: dict[str, tuple[str, str]], ordinality: str | None = None, nested: tuple[str, dict[str, tuple[str, str]]] | None = None) -> DataFrame:
    """JSON_TABLE over the array at `path` (members and subscripts). columns: name to (type, path); the type
    "exists" asks whether the path is there. nested: a path and the columns of its elements, outer-joined."""
    rows = df.select("*", F.posexplode(F.try_variant_get(F.parse_json(j), path, "array<variant>")).alias("__pos", "__row"))

    def cell(v: Column, kind: str, p: str) -> Column:
        return F.try_variant_get(v, p, "variant").isNotNull() if kind == "exists" else F.try_variant_get(v, p, kind)

    for name, (kind, p) in columns.items():
        rows = rows.withColumn(name, cell(F.col("__row"), kind, p))
    if ordinality:
        rows = rows.withColumn(ordinality, F.col("__pos") + 1)
    if nested:
        p, inner = nested
        rows = rows.select("*", F.explode_outer(F.try_variant_get(F.col("__row"), p, "array<variant>")).alias("__in"))
        for name, (kind, q) in inner.items():
            rows = rows.withColumn(name, cell(F.col("__in"), kind, q))
        rows = rows.drop("__in")
    return rows.drop("__pos", "__row")
