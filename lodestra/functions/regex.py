"""Regular expressions: first match unless told otherwise, `$` at the very end only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUPS = re.compile(r"\\.|\[(?:\\.|[^\]])*\]|(\((?!\?))")


def pattern(p: str, flags: str = "") -> str:
    """The pattern in Java's syntax: an unescaped `$` outside a class means the end of the subject."""
    out = re.sub(r"\\.|\[(?:\\.|[^\]])*\]|\$", lambda m: r"\z" if m[0] == "$" else m[0], p)
    return ("(?i)" if "i" in flags else "") + out


def groups(p: str) -> int:
    return sum(1 for m in _GROUPS.finditer(p) if m[1])


def template(r: str) -> str:
    """A replacement with \\1 and \\& as one with $1 and $0."""
    r = r.replace("$", r"\$")
    return re.sub(r"\\(\d|&)", lambda m: "$" + ("0" if m[1] == "&" else m[1]), r)


def matches(s: Column, p: str, flags: str = "") -> Column:
    return s.rlike(pattern(p, flags))


def regexp_replace(s: Column, p: str, r: str, flags: str = "") -> Column:
    if "g" in flags:
        return F.regexp_replace(s, pattern(p, flags), template(r))
    # The first match alone: what stands before it is group 1, the match group 2, its groups follow.
    moved = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}", template(r))
    return F.regexp_replace(s, f"(?s)^(.*?)({pattern(p, flags)})", "$1" + moved)


def regexp_match(s: Column, p: str, flags: str = "") -> Column:
    """The first match's groups as an array (the match itself if there are none), NULL without a match."""
    q, n = pattern(p, flags), groups(p)
    found = [F.regexp_extract(s, q, i) for i in (range(1, n + 1) if n else [0])]
    return F.when(s.rlike(q), F.array(*found))


def regexp_count(s: Column, p: str, start: int = 1, flags: str = "") -> Column:
    return F.regexp_count(F.substring(s, F.lit(start), F.char_length(s)), F.lit(pattern(p, flags)))


def regexp_substr(s: Column, p: str, start: int = 1, nth: int = 1, flags: str = "", group: int = 0) -> Column:
    return F.get(F.regexp_extract_all(F.substring(s, F.lit(start), F.char_length(s)), F.lit(pattern(p, flags)), group), F.lit(nth - 1))


def regexp_instr(s: Column, p: str, start: int = 1, nth: int = 1, end: bool = False, flags: str = "") -> Column:
    """Where the nth match starts (or the place after its end), 0 without one."""
    tail = F.substring(s, F.lit(start), F.char_length(s))
    before = rf"(?s)^(?:.*?(?:{pattern(p, flags)})){{{nth - 1}}}.*?(?={pattern(p, flags)})"
    upto = rf"(?s)^(?:.*?(?:{pattern(p, flags)})){{{nth}}}"
    length = F.char_length(F.regexp_extract(tail, upto if end else before, 0))
    return F.when(tail.rlike(upto), length + start).otherwise(F.when(s.isNotNull(), F.lit(0)))
