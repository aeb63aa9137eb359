"""Functions that statements may call by names Spark lacks, made in the session when a statement first names them.
Those with a SQL body stay in the JVM; those that need a whole JSON tree run in Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestra.functions import jsons

#: name: (parameters, result, body)
BODIES = {
    "jsonb_typeof": ("j string", "string", "case when j is null then null when left(ltrim(j), 1) = '{' then 'object' when left(ltrim(j), 1) = '[' then 'array' when left(ltrim(j), 1) = '\"' then 'string' when trim(j) in ('true', 'false') then 'boolean' when trim(j) = 'null' then 'null' else 'number' end"),
    "jsonb_array_length": ("j string", "int", "json_array_length(j)"),
    "json_serialize": ("j string", "string", "j"),
    "strpos": ("s string, part string", "int", "locate(part, s)"),
    "to_hex": ("n bigint", "string", "lower(hex(n))"),
    "quote_literal": ("s string", "string", "concat(case when contains(s, '\\\\') then ' E\\'' else '\\'' end, replace(replace(s, '\\\\', '\\\\\\\\'), '\\'', '\\'\\''), '\\'')"),
    "quote_ident": ("s string", "string", "case when rlike(s, '^[a-z_][a-z0-9_$]*$') then s else concat('\"', replace(s, '\"', '\"\"'), '\"') end"),
    "uuid_extract_version": ("u string", "smallint", "case when substr(u, 20, 1) in ('8', '9', 'a', 'b') then cast(conv(substr(u, 15, 1), 16, 10) as smallint) end"),
}


def _keys(path: str) -> list[str]:
    """The keys of a path text, {a,0,b}."""
    return [k.strip().strip('"') for k in path.strip()[1:-1].split(",")] if path.strip()[1:-1].strip() else []


#: name: (result, what makes it from the values of one row)
TREES = {
    "jsonb_contains": ("boolean", lambda a, b: jsons.holds(a, b)),
    "jsonb_strip_nulls": ("string", lambda a: jsons.dump(jsons.stripped(jsons.load(a)))),
    "jsonb_pretty": ("string", lambda a: jsons.dump(jsons.load(a), indent=4)),
    "jsonb_set": ("string", lambda a, path, new, create=True: jsons.put(_keys(path), new, create)(a)),
    "jsonb_insert": ("string", lambda a, path, new, after=False: jsons.inserted(_keys(path), new, after)(a)),
    "jsonb_path_exists": ("boolean", lambda a, path: bool(jsons.lenient(path, a))),
    "jsonb_path_query": ("array<string>", lambda a, path: [jsons.dump(y) for y in jsons.found(path, a)]),
    "jsonb_path_query_array": ("string", lambda a, path: jsons.dump(jsons.found(path, a))),
    "jsonb_path_query_first": ("string", lambda a, path: next((jsons.dump(y) for y in jsons.found(path, a)), None)),
}


def make(spark: SparkSession, words: set[str], made: set[str]) -> None:
    """Makes the functions among `words` that are not in `made` yet."""
    for name in words & (BODIES.keys() | TREES.keys()) - made:
        if name in BODIES:
            parameters, result, body = BODIES[name]
            spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
        else:
            kind, one = TREES[name]
            spark.udf.register(name, F.pandas_udf(jsons.rowwise(one), kind))
        made.add(name)
