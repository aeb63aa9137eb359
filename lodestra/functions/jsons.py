"""JSON held as text. Paths of members and subscripts stay in the JVM; what needs the whole tree (deep
containment, edits by path, pretty printing, the path language) runs in Arrow-batched functions."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestra.functions import jsonpath
from lodestra.functions.numeric import guard


def load(text: str) -> Any:
    """The value of a text; numbers keep all their digits."""
    return json.loads(text, parse_float=Decimal)


def _number(x: Any, equal: bool) -> str:
    if not isinstance(x, (int, Decimal)):
        return json.dumps(x)
    plain = format(x, "f") if isinstance(x, Decimal) else str(x)
    if equal and "." in plain:
        plain = plain.rstrip("0").rstrip(".")
    return "0" if equal and plain in ("-0", "-") else plain


def dump(x: Any, equal: bool = False, indent: int = 0, depth: int = 0) -> str:
    """The canonical text: members by length and name of their keys, one space behind commas and colons, numbers
    without exponents. With `equal`, equal numbers have one form; with `indent`, a line for each member and item."""
    if isinstance(x, (dict, list)):
        if isinstance(x, dict):
            parts = [f"{json.dumps(k, ensure_ascii=False)}: {dump(x[k], equal, indent, depth + 1)}" for k in sorted(x, key=lambda k: (len(k.encode()), k))]
        else:
            parts = [dump(y, equal, indent, depth + 1) for y in x]
        ends = "{}" if isinstance(x, dict) else "[]"
        if not indent or not parts:
            return ends[0] + ", ".join(parts) + ends[1]
        line = "\n" + " " * indent * (depth + 1)
        return ends[0] + line + ("," + line).join(parts) + "\n" + " " * indent * depth + ends[1]
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    return _number(x, equal)


def _over(kind: str, f: Callable[..., Any], *columns: Column) -> Column:
    """f over the values of JSON columns; NULL in gives NULL out, as does None."""

    return F.pandas_udf(rowwise(f), kind)(*columns)


def rowwise(f: Callable[..., Any]) -> Callable[..., pd.Series]:
    """f as a function of batches; a NULL among a row's values gives NULL."""

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*parts)], dtype=object)

    return run


def canonical(j: Column) -> Column:
    """The text that equal values share, for grouping and equality."""
    return _over("string", lambda x: dump(load(x), equal=True), j)


def typeof(j: Column) -> Column:
    head = F.substring(F.ltrim(j), 1, 1)
    return F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(head.isin("t", "f"), "boolean").when(head == "n", "null").when(j.isNotNull(), "number")


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise KeyError
    return dict(pairs)


def _unique_keys(text: str) -> bool:
    try:
        json.loads(text, object_pairs_hook=_unique)
    except KeyError:
        return False
    except ValueError:
        return True  # no JSON at all: for others to say
    return True


def is_json(j: Column, kind: str = "value", unique_keys: bool = False) -> Column:
    """IS JSON [VALUE | OBJECT | ARRAY | SCALAR] [WITH UNIQUE KEYS]. A text with repeated keys is JSON without the
    last clause, as its last key of a name counts."""
    valid = F.coalesce(F.try_parse_json(j).isNotNull(), F.lit(False)) | _over("boolean", _parses, j)
    t = typeof(j)
    held = valid if kind == "value" else valid & ((t == kind) if kind in ("object", "array") else ~t.isin("object", "array"))
    return held & _over("boolean", _unique_keys, j) if unique_keys else held


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _parses(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant)
    except ValueError:
        return False
    return True


def array_to_json(a: Column, pretty_lines: bool = False) -> Column:
    """An array as JSON text, nested arrays and NULLs included; pretty_lines puts a line feed behind its commas."""
    text = F.to_json(a, {"ignoreNullFields": "false"})
    if not pretty_lines:
        return text
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)), ",\n "), F.lit("]"))


def serialize(j: Column, kind: str = "string") -> Column:
    """JSON_SERIALIZE(j RETURNING text or bytea): the text as it is; 22032 if it is no JSON."""
    return guard(is_json(j), j, "22032", "invalid input for JSON").cast(kind)


def array_length(j: Column) -> Column:
    return guard(typeof(j) == "array", F.json_array_length(j), "22023", "cannot get array length of a non-array")


def get(j: Column, key: str | int) -> Column:
    """j -> key, as JSON text."""
    return F.to_json(F.try_variant_get(F.parse_json(j), member_path([key]), "variant"))


def get_text(j: Column, *keys: str | int) -> Column:
    """j ->> key and j #>> path"""
    return F.get_json_object(j, member_path(keys))


def get_path(j: Column, keys: list[str | int]) -> Column:
    """j #> path"""
    return F.to_json(F.try_variant_get(F.parse_json(j), member_path(keys), "variant"))


def member_path(keys: Any) -> str:
    """Spark's path of the keys. It has no form for a key with a quote beside a dot or a square bracket."""

    def part(k: str | int) -> str:
        if isinstance(k, int):
            return f"[{k}]"
        if k and k != "*" and "." not in k and "[" not in k:
            return f".{k}"
        if "'" in k:
            raise ValueError(f"[0A000] no path to the key {k!r}")
        return f"['{k}']"

    return "$" + "".join(map(part, keys))


def has_key(j: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(j), F.lit(key)), F.lit(False))


def has_any(j: Column, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(j), F.array(*map(F.lit, keys))), F.lit(False))


def has_all(j: Column, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(j))) == 0, F.lit(False))


def _holds(a: Any, b: Any, top: bool = True) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _holds(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_holds(x, y, False) for x in a) for y in b)
    if isinstance(a, list) and top:
        return any(_holds(x, b, False) for x in a)
    return type(a) in (type(b), int, float, Decimal) and isinstance(a, bool) == isinstance(b, bool) and a == b


def contains(a: Column, b: Column) -> Column:
    """a @> b"""
    return _over("boolean", holds, a, b)


def holds(a: str, b: str) -> bool:
    return _holds(load(a), load(b))


def stripped(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: stripped(v) for k, v in x.items() if v is not None}
    return [stripped(y) for y in x] if isinstance(x, list) else x


def strip_nulls(j: Column) -> Column:
    return _over("string", lambda x: dump(stripped(load(x))), j)


def pretty(j: Column) -> Column:
    return _over("string", lambda x: dump(load(x), indent=4), j)


def concat(a: Column, b: Column) -> Column:
    """a || b: objects merge, arrays append."""

    def join(x: str, y: str) -> str:
        p, q = load(x), load(y)
        if isinstance(p, dict) and isinstance(q, dict):
            return dump(p | q)
        return dump((p if isinstance(p, list) else [p]) + (q if isinstance(q, list) else [q]))

    return _over("string", join, a, b)


def _at(x: Any, keys: list[str]) -> Any:
    for k in keys:
        x = x[int(k)] if isinstance(x, list) else x[k]
    return x


def _edit(keys: list[str], change: Callable[[Any, str], None]) -> Callable[[str], str]:
    def run(x: str) -> str:
        root = load(x)
        try:
            change(_at(root, keys[:-1]), keys[-1])
        except (KeyError, IndexError, ValueError, TypeError):
            pass
        return dump(root)

    return run


def delete(j: Column, *keys: str | int) -> Column:
    """j - key, j - index and j #- path"""

    def change(at: Any, k: str) -> None:
        del at[int(k) if isinstance(at, list) else k]

    return _over("string", _edit([str(k) for k in keys], change), j)


def delete_keys(j: Column, keys: list[str]) -> Column:
    return _over("string", lambda x: dump({k: v for k, v in load(x).items() if k not in keys}), j)


def put(keys: list[str], new: str, create: bool = True) -> Callable[[str], str]:
    def change(at: Any, k: str) -> None:
        if isinstance(at, list):
            i = int(k)
            if -len(at) <= i < len(at):
                at[i] = load(new)
            elif create:
                at.insert(0 if i < 0 else len(at), load(new))
        elif create or k in at:
            at[k] = load(new)

    return _edit(keys, change)


def set_(j: Column, keys: list[str], new: str, create: bool = True) -> Column:
    return _over("string", put(keys, new, create), j)


def inserted(keys: list[str], new: str, after: bool = False) -> Callable[[str], str]:
    def change(at: Any, k: str) -> None:
        if isinstance(at, list):
            i = int(k)
            i = max(i + len(at), 0) if i < 0 else i
            at.insert(i + after, load(new))
        elif k not in at:
            at[k] = load(new)

    return _edit(keys, change)


def insert(j: Column, keys: list[str], new: str, after: bool = False) -> Column:
    return _over("string", inserted(keys, new, after), j)


def scalar(c: Column) -> Column:
    """A value as a JSON scalar."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def build_array(*columns: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array(*[F.coalesce(F.nullif(scalar(c), F.lit("")), F.lit("null")) for c in columns]), ", "), F.lit("]"))


def build_object(**columns: Column) -> Column:
    parts = [F.concat(F.lit(f"{json.dumps(k)}: "), F.coalesce(F.nullif(scalar(c), F.lit("")), F.lit("null"))) for k, c in columns.items()]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}"))


def object_of(keys: Column, values: Column) -> Column:
    return F.to_json(F.map_from_arrays(keys, values))


def path_exists(j: Column, path: str) -> Column:
    return _over("boolean", lambda x, p=jsonpath.parse(path): bool(_lenient(p, x)), j)


def path_query_array(j: Column, path: str) -> Column:
    return _over("string", lambda x, p=jsonpath.parse(path): dump(jsonpath.evaluate(p, load(x))), j)


def path_query(j: Column, path: str) -> Column:
    """An array of the texts that a path finds, for jsonb_path_query() as rows."""
    return _over("array<string>", lambda x, p=jsonpath.parse(path): [dump(y) for y in jsonpath.evaluate(p, load(x))], j)


def path_query_first(j: Column, path: str) -> Column:
    return _over("string", lambda x, p=jsonpath.parse(path): next((dump(y) for y in jsonpath.evaluate(p, load(x))), None), j)


def path_match(j: Column, path: str) -> Column:
    def run(x: str, p=jsonpath.parse(path)) -> bool | None:
        found = jsonpath.evaluate(p, load(x))
        return found[0] if len(found) == 1 and isinstance(found[0], bool) else None

    return _over("boolean", run, j)


def _lenient(path: tuple, text: str) -> list:
    try:
        return jsonpath.evaluate(path, load(text))
    except jsonpath.PathError:
        return []


def found(path: str, text: str) -> list:
    """What a path finds; the parsed path is kept."""
    return jsonpath.evaluate(_parsed(path), load(text))


def lenient(path: str, text: str) -> list:
    return _lenient(_parsed(path), text)


_parsed = functools.lru_cache(maxsize=64)(jsonpath.parse)

json_exists = path_exists


def json_value(j: Column, path: str, kind: str = "string", on_empty: Any = None, on_error: Any = None, strict_errors: bool = False) -> Column:
    """The scalar at a path of members and subscripts; NULL, or the given defaults, where there is none."""
    v = F.parse_json(j)
    item = F.try_variant_get(v, path, "variant")
    value = F.variant_get(v, path, kind) if strict_errors else F.coalesce(F.try_variant_get(v, path, kind), F.lit(on_error).cast(kind))
    return F.when(item.isNull(), F.lit(on_empty).cast(kind)).otherwise(value)


def json_query(j: Column, path: str, wrapper: bool = False) -> Column:
    found = F.to_json(F.try_variant_get(F.parse_json(j), path, "variant"))
    return F.when(found.isNotNull(), F.concat(F.lit("["), found, F.lit("]"))) if wrapper else found
