"""String functions with positional windows that clip instead of counting from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestra.functions.numeric import guard


def _c(x: str | int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def substr(s: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """The characters at positions start .. start + length - 1 that exist."""
    start = _c(start)
    low = F.greatest(start, F.lit(1))
    if length is None:
        return F.substring(s, low, F.greatest(F.char_length(s), F.lit(0)))
    length = _c(length)
    return guard(length >= 0, F.substring(s, low, F.greatest(start + length, F.lit(1)) - F.least(low, F.greatest(start + length, F.lit(1)))), "22011", "negative substring length")


def left(s: Column, n: int | Column) -> Column:
    """The first n characters; for a negative n all but the last -n."""
    n = _c(n)
    return F.substring(s, F.lit(1), F.when(n < 0, F.greatest(F.char_length(s) + n, F.lit(0))).otherwise(n))


def right(s: Column, n: int | Column) -> Column:
    """The last n characters; for a negative n all but the first -n."""
    n = _c(n)
    keep = F.when(n < 0, F.greatest(F.char_length(s) + n, F.lit(0))).otherwise(F.least(n, F.char_length(s)))
    return F.substring(s, F.char_length(s) - keep + 1, keep)


def initcap(s: Column) -> Column:
    """Words are runs of ASCII letters and digits."""
    runs = F.regexp_extract_all(s, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.char_length(x))))), "")


def chr_(n: Column) -> Column:
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return guard(ok, F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32"), "22023", "no such character")


def to_hex(n: Column, bits: int = 64) -> Column:
    return F.lower(F.hex(n.cast("long")) if bits == 64 else F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))


def encode(b: Column, form: str) -> Column:
    if form == "hex":
        return F.lower(F.hex(b))
    if form == "base64":
        return F.regexp_replace(F.regexp_replace(F.base64(b), "[\r\n]", ""), "(.{76})(?=.)", "$1\n")
    raise ValueError(f"[22023] no such encoding: {form}")


def decode(s: Column, form: str) -> Column:
    if form == "hex":
        return guard(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s), "22023", "bad hexadecimal data")
    if form == "base64":
        return F.unbase64(F.regexp_replace(s, r"\s", ""))
    raise ValueError(f"[22023] no such encoding: {form}")


def quote_literal(s: Column) -> Column:
    body = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.when(F.contains(s, F.lit("\\")), F.lit(" E'")).otherwise(F.lit("'")), body, F.lit("'"))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column) -> Column:
    return F.when(s.rlike("^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def strpos(s: Column, part: Column) -> Column:
    return F.position(part, s)


def bounded_repeat(s: Column, n: Column) -> Column:
    return guard(F.char_length(s) * F.greatest(n, F.lit(0)) <= 0x3FFFFFFF, F.repeat(s, n), "54000", "requested length too large")
