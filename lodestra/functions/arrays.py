"""Array functions with element matching in which NULL matches NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ndims(a: Column, kind: T.DataType) -> Column:
    """The nesting depth; NULL for an empty array."""
    depth = 0
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return F.when(F.size(a) > 0, F.lit(depth))


def length(a: Column, dim: int = 1) -> Column:
    for _ in range(dim - 1):
        a = F.get(a, F.lit(0))
    return F.when(F.size(a) > 0, F.size(a))


def lower(a: Column, dim: int = 1) -> Column:
    return F.when(length(a, dim).isNotNull(), F.lit(1))


upper = length


def cardinality(a: Column, dims: int = 1) -> Column:
    for _ in range(dims - 1):
        a = F.flatten(a)
    return F.size(a)


def dims(a: Column, n: int = 1) -> Column:
    return F.when(F.size(a) > 0, F.concat(*[F.concat(F.lit("[1:"), length(a, d + 1).cast("string"), F.lit("]")) for d in range(n)]))


def cat(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def remove(a: Column, e: Column) -> Column:
    return F.filter(a, lambda x: ~x.eqNullSafe(e))


def replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def positions(a: Column, e: Column) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(e), i + 1)), lambda p: p.isNotNull())


def position(a: Column, e: Column, start: int = 1) -> Column:
    """The first place from `start` on, NULL if there is none."""
    return F.get(F.filter(positions(a, e), lambda p: p >= start), F.lit(0))


def contains(a: Column, b: Column) -> Column:
    """a @> b: each element of b is in a; a NULL element is in nothing."""
    return F.forall(b, lambda x: F.coalesce(F.exists(a, lambda y: F.coalesce(y == x, F.lit(False))), F.lit(False)))


def overlaps(a: Column, b: Column) -> Column:
    """a && b"""
    return F.exists(a, lambda x: F.coalesce(F.exists(b, lambda y: F.coalesce(y == x, F.lit(False))), F.lit(False)))


def any_of(a: Column, test) -> Column:
    """value op ANY(array): TRUE on a match, else UNKNOWN if some element gives UNKNOWN."""
    return F.exists(a, test)


def all_of(a: Column, test) -> Column:
    return F.forall(a, test)


def item(a: Column, i: int | Column) -> Column:
    """The element at a 1-based place, NULL outside."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when(i >= 1, F.get(a, i - 1))


def slice_(a: Column, low: int, high: int) -> Column:
    low = max(low, 1)
    return F.slice(a, F.lit(low), F.lit(max(high - low + 1, 0)))
