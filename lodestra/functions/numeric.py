"""Exact, trapping arithmetic on top of Spark's: results keep their family, domain errors raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE, WIDE_AVG = "decimal(38,0)", "decimal(26,12)"


def _fail(code: str, message: str) -> Column:
    return F.raise_error(F.lit(f"[{code}] {message}"))


def guard(ok: Column, value: Column, code: str, message: str) -> Column:
    """value where ok or where ok is unknown; an error with an SQLSTATE elsewhere."""
    return F.when(~ok, _fail(code, message)).otherwise(value)


def int_div(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Division of integers that truncates towards zero and traps on zero."""
    return guard(b != 0, ((a - F.try_mod(a, b)).cast("decimal(38,0)") / b.cast("decimal(19,0)")).cast(kind), "22012", "division by zero")


def int_mod(a: Column, b: Column) -> Column:
    """The remainder, with the sign of the dividend."""
    return guard(b != 0, a % b, "22012", "division by zero")


def sum_wide(c: Column) -> Column:
    """The sum of 64-bit integers as a decimal, which cannot overflow on the way."""
    return F.sum(c.cast(WIDE))


def avg_exact(c: Column) -> Column:
    """The average of integers or decimals as a decimal, rounded half away from zero."""
    return F.avg(c.cast(WIDE_AVG))


def to_int(c: Column, kind: str = "int") -> Column:
    """A cast to an integer that rounds half away from zero, as for decimals so for doubles."""
    return (F.signum(c) * F.floor(F.abs(c) + F.lit(0.5))).cast(kind)


def trunc(c: Column, digits: int = 0) -> Column:
    if digits == 0:
        return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    scale = F.lit(10**digits).cast("decimal(20,0)")
    return F.signum(c).cast("int") * F.floor(F.abs(c).cast("decimal(30,10)") * scale) / scale


def checked(c: Column) -> Column:
    """A double that must be finite."""
    return guard(~(F.abs(c) == F.lit(float("inf"))), c, "22003", "value out of range")


def sqrt(c: Column) -> Column:
    return guard(c >= 0, F.sqrt(c), "2201F", "square root of a negative number")


def ln(c: Column) -> Column:
    return guard(c > 0, F.log(c), "2201E", "logarithm of a number that is not positive")


def log10(c: Column) -> Column:
    return guard(c > 0, F.log10(c), "2201E", "logarithm of a number that is not positive")


def log(base: Column, c: Column) -> Column:
    return ln(c) / ln(base)


def power(a: Column, b: Column) -> Column:
    return guard(~((a == 0) & (b < 0)) & ~((a < 0) & (b != F.floor(b))), checked(F.pow(a, b)), "2201F", "power out of domain")


def _unit(name: str):
    return lambda c: guard((c >= -1) & (c <= 1), getattr(F, name)(c), "22003", "input is out of range")


asin, acos, atanh = _unit("asin"), _unit("acos"), _unit("atanh")


def acosh(c: Column) -> Column:
    return guard(c >= 1, F.acosh(c), "22003", "input is out of range")


def factorial(n: Column) -> Column:
    """Up to 33!, the largest that fits 38 digits; beyond, an error."""
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(1).cast(WIDE), lambda acc, x: (acc * x.cast("decimal(4,0)")).cast(WIDE))
    return guard((n >= 0) & (n <= 33), product, "22003", "factorial out of range")


def _digits(c: Column) -> Column:
    return F.regexp_extract(c.cast("string"), r"\.(\d+)$", 1)


def scale(c: Column) -> Column:
    return F.length(_digits(c))


def min_scale(c: Column) -> Column:
    return F.length(F.regexp_replace(_digits(c), "0+$", ""))


def trim_scale(c: Column) -> Column:
    """The number as text without zeros at its end."""
    return F.when(F.instr(c.cast("string"), ".") > 0, F.regexp_replace(F.regexp_replace(c.cast("string"), "0+$", ""), r"\.$", "")).otherwise(c.cast("string"))


def gcd(a: Column, b: Column) -> Column:
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(F.try_mod(s["x"], s["y"])).alias("y")))
    return step["x"]


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise((F.abs(a) / g).cast("bigint") * F.abs(b))
