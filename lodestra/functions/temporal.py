"""Dates, timestamps and intervals. An interval is a struct of months, days and micros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def interval(months: int | Column = 0, days: int | Column = 0, micros: int | Column = 0) -> Column:
    c = lambda x, k: (x if isinstance(x, Column) else F.lit(x)).cast(k)
    return F.struct(c(months, "int").alias("months"), c(days, "int").alias("days"), c(micros, "bigint").alias("micros"))


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0.0) -> Column:
    return interval(years * 12 + months, weeks * 7 + days, F.round((F.lit(hours) * 3600 + F.lit(mins) * 60 + F.lit(secs)) * 1_000_000))


def span(i: Column) -> Column:
    """What intervals compare and group by: a month counts 30 days."""
    return (i["months"].cast("decimal(38,0)") * 30 + i["days"]).cast("decimal(28,0)") * F.lit(DAY).cast("decimal(12,0)") + i["micros"]


def native(i: Column) -> Column:
    return F.make_interval(F.lit(0), i["months"], F.lit(0), i["days"], F.lit(0), F.lit(0), (i["micros"] / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))


def add(ts: Column, i: Column) -> Column:
    """Months first (clipped to the month's end), then days, then time."""
    return ts + native(i)


def subtract(ts: Column, i: Column) -> Column:
    return ts - native(i)


def negate(i: Column) -> Column:
    return interval(-i["months"], -i["days"], -i["micros"])


def plus(a: Column, b: Column) -> Column:
    return interval(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def times(i: Column, n: int | Column) -> Column:
    return interval(i["months"] * n, i["days"] * n, i["micros"] * n)


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def difference(later: Column, earlier: Column) -> Column:
    """timestamp - timestamp: whole days split out, no months."""
    m = micros_between(later, earlier)
    days = F.signum(m).cast("bigint") * F.floor(F.abs(m) / DAY)
    return interval(0, days, m - days * DAY)


_PLAIN = {"year", "quarter", "month", "week", "day", "doy", "hour", "minute"}


def extract(field: str, v: Column) -> Column:
    """Any date or timestamp field, as a double."""
    f = field.lower()
    year = F.year(v)
    if f in _PLAIN:
        out = F.extract(F.lit(f.upper()), v)
    elif f == "isoyear":
        out = F.extract(F.lit("YEAROFWEEK"), v)
    elif f == "isodow":
        out = F.weekday(v) + 1
    elif f == "dow":
        out = F.dayofweek(v) - 1
    elif f == "decade":
        out = F.floor(year / 10)
    elif f in ("century", "millennium"):
        n = 100 if f == "century" else 1000
        out = F.when(year > 0, F.floor((year + n - 1) / n)).otherwise(-F.floor((n - year) / n))
    elif f == "second":
        out = F.extract(F.lit("SECOND"), v)
    elif f in ("milliseconds", "microseconds"):
        out = F.extract(F.lit("SECOND"), v) * (1000 if f == "milliseconds" else 1_000_000)
    elif f == "epoch":
        out = F.unix_micros(v.cast("timestamp")) / F.lit(1_000_000.0)
    elif f == "julian":
        out = F.datediff(v.cast("date"), F.lit("1970-01-01").cast("date")) + 2440588
    else:
        raise ValueError(f"[22023] no such field: {field}")
    return out.cast("double")


date_part = extract


def date_part_interval(field: str, i: Column) -> Column:
    f = field.lower()
    m, micros = i["months"], i["micros"]
    out = {
        "year": F.signum(m) * F.floor(F.abs(m) / 12), "month": m % 12, "quarter": F.floor((m % 12) / 3) + 1, "day": i["days"],
        "hour": F.signum(micros) * F.floor(F.abs(micros) / 3_600_000_000), "minute": F.signum(micros) * F.floor(F.abs(micros) % 3_600_000_000 / 60_000_000),
        "second": micros % 60_000_000 / 1e6, "milliseconds": micros % 60_000_000 / 1e3, "microseconds": micros % 60_000_000,
        "epoch": (F.signum(m) * F.floor(F.abs(m) / 12) * 365.25 + (m % 12) * 30 + i["days"]) * 86400 + micros / 1e6,
    }
    if f not in out:
        raise ValueError(f"[22023] no such field: {field}")
    return out[f].cast("double")


def date_trunc(unit: str, v: Column, kind: str = "timestamp_ntz") -> Column:
    u = unit.lower()
    years = {"decade": 10, "century": 100, "millennium": 1000}
    if u in years:
        n = years[u]
        y = F.year(v)
        first = F.floor(y / 10) * 10 if u == "decade" else F.floor((y - 1) / n) * n + 1
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast(kind)
    return F.date_trunc(u, v).cast(kind)


def at_zone(v: Column, zone: str, from_utc: bool = True) -> Column:
    """An instant's local time in a zone (timestamp to timestamp_ntz), or the other way round."""
    a, b = (F.lit("UTC"), F.lit(zone)) if from_utc else (F.lit(zone), F.lit("UTC"))
    return F.convert_timezone(a, b, v.cast("timestamp_ntz"))


def make_timestamptz(year, month, day, hour, minute, second, zone: str | None = None) -> Column:
    """A point in time from local fields in a zone (the session's by default)."""
    parts = [F.lit(x) if not isinstance(x, Column) else x for x in (year, month, day, hour, minute, second)]
    return F.make_timestamp_ltz(*parts, F.lit(zone)) if zone else F.make_timestamp_ltz(*parts)


def special_date(word: str, today: Column | None = None) -> Column:
    """The dates that a text names relative to the clock: epoch, today, tomorrow, yesterday. `today` is the seam
    for a clock of one's own."""
    day = today if today is not None else F.current_date()
    moves = {"epoch": None, "today": 0, "now": 0, "tomorrow": 1, "yesterday": -1}
    if word.strip().lower() not in moves:
        raise ValueError(f"[22007] invalid input syntax for type date: {word!r}")
    move = moves[word.strip().lower()]
    return F.lit("1970-01-01").cast("date") if move is None else F.date_add(day, move)


def date_trunc_zone(unit: str, v: Column, zone: str) -> Column:
    """date_trunc(unit, timestamptz, zone): cut in the zone's local time, back as a point in time. v is in UTC."""
    local = F.from_utc_timestamp(v, zone)
    return F.to_utc_timestamp(F.date_trunc(unit, local), zone)
