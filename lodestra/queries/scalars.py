"""Scalar functions: numbers, text, regular expressions, time."""

from __future__ import annotations


from pyspark.sql import functions as F

from lodestra.functions import numeric as num
from lodestra.functions import regex as rx
from lodestra.functions import temporal as tm
from lodestra.functions import text as tx
from lodestra.queries.base import both, same
from lodestra.registry import query
from lodestra.sources.readers import parquet

col, lit = F.col, F.lit

# Numbers

both("num_integer_division", "select o_orderkey, cast(o_custkey div 7 as bigint) as q, o_custkey % 7 as r, cast((-o_custkey) div 7 as bigint) as nq, (-o_custkey) % 7 as nr from orders",
     "select o_orderkey, o_custkey // 7 as q, o_custkey % 7 as r, cast(trunc((-o_custkey) / 7) as bigint) as nq, (-o_custkey) % 7 as nr from orders")
same("num_decimal_arithmetic", "select o_orderkey, cast(cast(o_totalprice as decimal(12,2)) + cast(1.25 as decimal(12,2)) as double) as a, cast(cast(o_totalprice as decimal(12,2)) * cast(3 as decimal(4,0)) as double) as m from orders")
same("num_float_order", "select x from (values (cast('NaN' as double)), (cast('Infinity' as double)), (-1.5e0), (0e0)) t(x) order by x limit 3")
same("num_trigonometry", """select l_linenumber as k, round(sin(l_linenumber), 9) as a, round(cos(l_linenumber), 9) as b, round(tan(l_linenumber), 9) as c, round(cot(l_linenumber), 9) as d,
    round(atan(l_linenumber), 9) as e, round(atan2(l_linenumber, 2), 9) as f, round(radians(l_linenumber), 9) as g, round(degrees(l_linenumber), 9) as h, round(pi(), 9) as i,
    round(cbrt(l_linenumber), 9) as j, round(sinh(l_linenumber), 6) as l, round(cosh(l_linenumber), 6) as m, round(tanh(l_linenumber), 9) as n, round(asinh(l_linenumber), 9) as o from lineitem""")
same("num_width_bucket_case", "select o_orderkey, case when o_totalprice < 1000 then 0 when o_totalprice >= 100000 then 11 else floor((o_totalprice - 1000) / 9900) + 1 end as b from orders")


@query("num_div_mod", "select o_orderkey as k, o_orderkey // 7 as q, o_orderkey % 7 as r from orders")
def num_div_mod(spark, sf_dir):
    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), num.int_div(col("o_orderkey"), lit(7)).alias("q"), num.int_mod(col("o_orderkey"), lit(7)).alias("r"))


@query("num_rounding", "select o_orderkey as k, abs(o_totalprice) as a, cast(round(o_totalprice, 1) as double) as r, ceil(o_totalprice) as c, floor(o_totalprice) as f, trunc(-o_totalprice) as t, sign(o_totalprice - 50000) as s, cast(floor(o_totalprice + 0.5) as bigint) as i from orders")
def num_rounding(spark, sf_dir):
    p = col("o_totalprice")
    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), F.abs(p).alias("a"), F.round(p, 1).alias("r"), F.ceil(p).alias("c"), F.floor(p).alias("f"), num.trunc(-p).alias("t"), F.signum(p - 50000).alias("s"), num.to_int(p, "bigint").alias("i"))


@query("num_half_away", "select * from (values (2.5, 3, 3, 2.0), (-2.5, -3, -3, -2.0), (0.5, 1, 1, 0.0), (1.4, 1, 1, 1.0)) t(x, r, i, t)")
def num_half_away(spark, sf_dir):
    t = spark.sql("select x from values (2.5d), (-2.5d), (0.5d), (1.4d) t(x)")
    return t.select("x", F.round("x").cast("int").alias("r"), num.to_int(col("x")).alias("i"), num.trunc(col("x")).cast("double").alias("t"))


@query("num_exp_log_power", "select o_orderkey as k, round(sqrt(o_totalprice), 6) as a, round(exp(o_custkey % 10), 4) as b, round(ln(o_totalprice), 8) as c, round(log10(o_totalprice), 8) as d, round(ln(o_totalprice) / ln(2), 7) as e, round(power(o_custkey % 10, 2), 4) as f from orders")
def num_exp_log(spark, sf_dir):
    p, b = col("o_totalprice"), (col("o_custkey") % 10).cast("double")
    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), F.round(num.sqrt(p), 6).alias("a"), F.round(num.checked(F.exp(b)), 4).alias("b"), F.round(num.ln(p), 8).alias("c"), F.round(num.log10(p), 8).alias("d"), F.round(num.log(lit(2.0), p), 7).alias("e"), F.round(num.power(b, lit(2.0)), 4).alias("f"))


@query("num_domain_functions", "select l_orderkey as k, l_linenumber as n, round(asin(l_discount), 9) as a, round(acos(l_discount), 9) as b, round(atanh(l_discount), 9) as c, round(acosh(l_linenumber), 9) as d from lineitem")
def num_domain(spark, sf_dir):
    d = col("l_discount")
    return parquet(spark, sf_dir, "lineitem").select(col("l_orderkey").alias("k"), col("l_linenumber").alias("n"), F.round(num.asin(d), 9).alias("a"), F.round(num.acos(d), 9).alias("b"), F.round(num.atanh(d), 9).alias("c"), F.round(num.acosh(col("l_linenumber").cast("double")), 9).alias("d"))


@query("num_gcd_lcm_factorial", "select o_orderkey as k, gcd(o_orderkey, o_custkey) as g, lcm(o_orderkey, o_custkey) as l, cast(factorial(cast(o_custkey % 18 as integer)) as double) as f from orders")
def num_gcd(spark, sf_dir):
    a, b = col("o_orderkey"), col("o_custkey")
    return parquet(spark, sf_dir, "orders").select(a.alias("k"), num.gcd(a, b).alias("g"), num.lcm(a, b).alias("l"), num.factorial(b % 18).cast("double").alias("f"))




@query("num_width_bucket", "select o_orderkey as k, case when o_totalprice < 0 then 0 when o_totalprice >= 200000 then 9 else cast(floor(o_totalprice / 25000) as bigint) + 1 end as b from orders")
def num_width_bucket(spark, sf_dir):
    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), F.width_bucket(col("o_totalprice"), lit(0.0), lit(200000.0), lit(8)).alias("b"))


@query("num_scale", "select * from (values (1, 3, 1, '1.5'), (2, 3, 0, '2'), (3, 3, 3, '0.125')) t(k, s, m, t)")
def num_scale(spark, sf_dir):
    d = spark.sql("select k, cast(x as decimal(10,3)) as x from values (1, 1.5), (2, 2), (3, 0.125) t(k, x)")
    return d.select("k", num.scale(col("x")).alias("s"), num.min_scale(col("x")).alias("m"), num.trim_scale(col("x")).alias("t"))


# Text

same("txt_case_and_length", "select p_partkey, lower(p_name) as a, upper(p_name) as b, length(p_name) as c, char_length(p_name) as d, bit_length(p_name) as f from part")
same("txt_pad_trim", "select p_partkey, lpad(p_brand, 12, '*') as a, rpad(p_brand, 12, '-') as b, trim('  ' || p_brand || ' ') as c, ltrim('xx' || p_brand) as d, rtrim(p_brand || '  ') as e, replace(p_name, 'a', 'oo') as f, translate(p_name, 'aeiou', 'AEIOU') as g, repeat('ab', 3) as h, reverse(p_brand) as i from part")
same("txt_split_and_search", "select p_partkey, split_part(p_name, ' ', 1) as a, p_name like 'P%' as s, ascii(p_brand) as c, concat(p_brand, '/', p_name) as d from part")


@query("txt_substrings", "select p_partkey as k, substr(p_name, 2, 3) as a, substr(p_name, 1, 2) as b, left(p_name, 3) as c, left(p_name, -3) as d, right(p_name, 2) as e, right(p_name, -2) as f, instr(p_name, 'a') as g from part")
def txt_substrings(spark, sf_dir):
    n = col("p_name")
    return parquet(spark, sf_dir, "part").select(col("p_partkey").alias("k"), tx.substr(n, 2, 3).alias("a"), tx.substr(n, 0, 3).alias("b"), tx.left(n, 3).alias("c"), tx.left(n, -3).alias("d"), tx.right(n, 2).alias("e"), tx.right(n, -2).alias("f"), tx.strpos(n, lit("a")).alias("g"))


@query("txt_substr_windows", "select * from (values ('hello', 'he', 'o', '', 'hello')) t(s, a, b, c, d)")
def txt_windows(spark, sf_dir):
    t = spark.sql("select 'hello' as s")
    return t.select("s", tx.substr(col("s"), 0, 3).alias("a"), tx.substr(col("s"), 5, 9).alias("b"), tx.substr(col("s"), -3, 2).alias("c"), tx.substr(col("s"), -2).alias("d"))


@query("txt_characters", "select * from (values ('hi THERE-you', 'Hi There-You', 'A', '€', 'ff', 'ffffffff', '😀')) t(s, i, c, d, h, n, e)")
def txt_characters(spark, sf_dir):
    t = spark.sql("select 'hi THERE-you' as s")
    return t.select("s", tx.initcap(col("s")).alias("i"), tx.chr_(lit(65)).alias("c"), tx.chr_(lit(8364)).alias("d"), tx.to_hex(lit(255)).alias("h"), tx.to_hex(lit(-1), 32).alias("n"), tx.chr_(lit(0x1F600)).alias("e"))


@query("txt_encode_decode", "select p_partkey as k, lower(hex(p_name)) as h, to_base64(encode(p_name)) as b, p_name as r, p_name as s from part")
def txt_encode(spark, sf_dir):
    b = F.encode(col("p_name"), "UTF-8")
    return parquet(spark, sf_dir, "part").select(col("p_partkey").alias("k"), tx.encode(b, "hex").alias("h"), tx.encode(b, "base64").alias("b"), F.decode(tx.decode(tx.encode(b, "hex"), "hex"), "UTF-8").alias("r"), F.decode(tx.decode(tx.encode(b, "base64"), "base64"), "UTF-8").alias("s"))


@query("txt_quoting", """select * from (values ('it''s', '''it''''s''', '"it''s"', '''it''''s'''), ('abc', '''abc''', 'abc', '''abc'''), (null, null, null, 'NULL')) t(s, l, i, n)""")
def txt_quoting(spark, sf_dir):
    t = spark.createDataFrame([("it's",), ("abc",), (None,)], "s string")
    return t.select("s", tx.quote_literal(col("s")).alias("l"), tx.quote_ident(col("s")).alias("i"), tx.quote_nullable(col("s")).alias("n"))


# Regular expressions


@query("rx_match_operators", "select p_partkey as k, regexp_matches(p_name, '^[A-Za-z]+') as a, regexp_matches(p_name, '(?i)^P') as b, not regexp_matches(p_name, '[0-9]$') as c from part")
def rx_match(spark, sf_dir):
    n = col("p_name")
    return parquet(spark, sf_dir, "part").select(col("p_partkey").alias("k"), rx.matches(n, "^[A-Za-z]+").alias("a"), rx.matches(n, "^P", "i").alias("b"), (~rx.matches(n, "[0-9]$")).alias("c"))


@query("rx_replace", r"select p_partkey as k, regexp_replace(p_name, '([a-z])([a-z])', '\2\1') as f, regexp_replace(p_name, '([a-z])([a-z])', '\2\1', 'g') as g, regexp_replace(p_name, '[A-Z]', 'x') as h from part")
def rx_replace(spark, sf_dir):
    n = col("p_name")
    return parquet(spark, sf_dir, "part").select(col("p_partkey").alias("k"), rx.regexp_replace(n, "([a-z])([a-z])", r"\2\1").alias("f"), rx.regexp_replace(n, "([a-z])([a-z])", r"\2\1", "g").alias("g"), rx.regexp_replace(n, "[A-Z]", "x").alias("h"))


@query("rx_extract", r"select p_partkey as k, case when regexp_matches(p_name, '([a-z]+)') then regexp_extract(p_name, '([a-z]+)', 1) end as m, len(regexp_extract_all(p_name, '[aeiou]')) as c, list_extract(regexp_extract_all(p_name, '[a-z]+'), 1) as s, list_extract(regexp_extract_all(p_name, '[aeiou]'), 2) as t from part")
def rx_extract(spark, sf_dir):
    n = col("p_name")
    return parquet(spark, sf_dir, "part").select(col("p_partkey").alias("k"), F.get(rx.regexp_match(n, "([a-z]+)"), lit(0)).alias("m"), rx.regexp_count(n, "[aeiou]").alias("c"), rx.regexp_substr(n, "[a-z]+").alias("s"), rx.regexp_substr(n, "[aeiou]", nth=2).alias("t"))


@query("rx_instr", "select * from (values ('abcabc', 2, 5, 3, 0)) t(s, a, b, c, d)")
def rx_instr(spark, sf_dir):
    t = spark.sql("select 'abcabc' as s")
    return t.select("s", rx.regexp_instr(col("s"), "b").alias("a"), rx.regexp_instr(col("s"), "b", nth=2).alias("b"), rx.regexp_instr(col("s"), "b", end=True).alias("c"), rx.regexp_instr(col("s"), "z").alias("d"))


both("rx_filter_scan", "select count(*) as n from documents where text rlike '[aeiou]{2}'", "select count(*) as n from documents where regexp_matches(text, '[aeiou]{2}')")

# Time

_FIELDS = ["year", "quarter", "month", "week", "day", "doy", "dow", "isodow", "isoyear", "hour", "minute", "decade", "century", "millennium", "epoch"]


@query("tm_extract", "select o_orderkey as k, " + ", ".join(f"cast(extract({f} from o_orderdate) as double) as f{i}" for i, f in enumerate(_FIELDS)) + " from orders")
def tm_extract(spark, sf_dir):
    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), *(tm.extract(f, col("o_orderdate")).alias(f"f{i}") for i, f in enumerate(_FIELDS)))


@query("tm_seconds", "select event_id as k, cast(second(ts) as double) as s, cast(millisecond(ts) as double) as m from events")
def tm_seconds(spark, sf_dir):
    return parquet(spark, sf_dir, "events").select(col("event_id").alias("k"), F.floor(tm.extract("second", col("ts"))).alias("s"), F.floor(tm.date_part("milliseconds", col("ts"))).alias("m"))


_UNITS = ["year", "quarter", "month", "week", "day", "hour", "minute", "decade", "century", "millennium"]
#: Centuries and millennia begin with year 1 here, with year 0 in the oracle's own function.
_SPANS = {"century": 100, "millennium": 1000}


@query("tm_date_trunc", "select event_id as k, " + ", ".join((f"make_timestamp((year(ts) - 1) // {_SPANS[u]} * {_SPANS[u]} + 1, 1, 1, 0, 0, 0.0)" if u in _SPANS else f"cast(date_trunc('{u}', ts) as timestamp)") + f" as u{i}" for i, u in enumerate(_UNITS)) + " from events")
def tm_trunc(spark, sf_dir):
    return parquet(spark, sf_dir, "events").select(col("event_id").alias("k"), *(tm.date_trunc(u, col("ts")).alias(f"u{i}") for i, u in enumerate(_UNITS)))


@query("tm_interval_arithmetic", "select o_orderkey as k, o_orderdate + interval 1 month + interval 3 day as a, o_orderdate - interval 2 hour as b, cast(o_orderdate as date) + 5 as d, cast(date_diff('day', timestamp '1992-01-01', o_orderdate) as bigint) as n from orders")
def tm_interval(spark, sf_dir):
    t = col("o_orderdate")
    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), tm.add(tm.add(t, tm.make_interval(months=1)), tm.make_interval(days=3)).alias("a"), tm.subtract(t, tm.make_interval(hours=2)).alias("b"), F.date_add(t.cast("date"), 5).alias("d"), F.datediff(t.cast("date"), lit("1992-01-01").cast("date")).cast("bigint").alias("n"))


@query("tm_difference", "select event_id as k, cast(epoch_us(ts) - epoch_us(timestamp '2020-01-01') as bigint) as m, cast((epoch_us(ts) - epoch_us(timestamp '2020-01-01')) // 86400000000 as bigint) as d from events where ts >= timestamp '2020-01-01'")
def tm_difference(spark, sf_dir):
    e = parquet(spark, sf_dir, "events").where("ts >= timestamp_ntz'2020-01-01'")
    base = lit("2020-01-01").cast("timestamp_ntz")
    i = tm.difference(col("ts"), base)
    return e.select(col("event_id").alias("k"), tm.micros_between(col("ts"), base).alias("m"), i["days"].alias("d"))


@query("tm_interval_order", "select * from (values (1, 30, true, 2592000000000.0), (2, 31, false, 2678400000000.0)) t(k, days, eq_month, span)")
def tm_interval_order(spark, sf_dir):
    t = spark.sql("select k, days from values (1, 30), (2, 31) t(k, days)")
    i = tm.interval(0, col("days"), 0)
    return t.select("k", "days", (tm.span(i) == tm.span(tm.interval(1))).alias("eq_month"), tm.span(i).cast("double").alias("span"))


@query("tm_make", "select event_id as k, make_date(cast(2000 + event_id % 20 as bigint), 1 + event_id % 12, 1 + event_id % 28) as d, make_timestamp(2000 + event_id % 20, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, 1.5) as t from events")
def tm_make(spark, sf_dir):
    e = col("event_id").cast("int")
    parts = [lit(2000) + e % 20, lit(1) + e % 12, lit(1) + e % 28]
    return parquet(spark, sf_dir, "events").select(col("event_id").alias("k"), F.make_date(*parts).alias("d"), F.make_timestamp_ntz(*parts, e % 24, e % 60, lit(1.5).cast("decimal(16,6)")).alias("t"))


@query("tm_time_zone", "select event_id as k, timezone('America/New_York', cast(ts as timestamptz)) as ny, timezone('Asia/Tokyo', cast(ts as timestamptz)) as tk from events")
def tm_zone(spark, sf_dir):
    return parquet(spark, sf_dir, "events").select(col("event_id").alias("k"), tm.at_zone(col("ts"), "America/New_York").alias("ny"), tm.at_zone(col("ts"), "Asia/Tokyo").alias("tk"))


@query("tm_date_relative", "select o_orderkey as k, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as since, cast(cast(o_orderdate as date) + 1 as varchar) as next, cast(cast(o_orderdate as date) - 1 as varchar) as before from orders")
def tm_date_relative(spark, sf_dir):
    """'epoch', 'tomorrow' and 'yesterday' against a clock that stands at each order's date."""
    today = col("o_orderdate").cast("date")
    say = lambda w: tm.special_date(w, today)
    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), F.datediff(say("today"), say("epoch")).cast("bigint").alias("since"), say("tomorrow").cast("string").alias("next"), say("yesterday").cast("string").alias("before"))


@query("tm_make_timestamptz", "select event_id as k, epoch_us(make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 0.0)) - 19800000000 as us from events")
def tm_make_timestamptz(spark, sf_dir):
    """Local fields of a zone five and a half hours ahead."""
    part = lambda f: F.extract(lit(f), col("ts")).cast("int")
    t = tm.make_timestamptz(*(part(f) for f in ("year", "month", "day", "hour", "minute")), lit(0).cast("decimal(16,6)"), "Asia/Kolkata")
    return parquet(spark, sf_dir, "events").select(col("event_id").alias("k"), F.unix_micros(t).alias("us"))


@query("tm_date_trunc_zone", "select event_id as k, epoch_us(date_trunc('day', ts + interval 330 minute) - interval 330 minute) as us from events")
def tm_date_trunc_zone(spark, sf_dir):
    return parquet(spark, sf_dir, "events").select(col("event_id").alias("k"), F.unix_micros(tm.date_trunc_zone("day", col("ts").cast("timestamp"), "Asia/Kolkata").cast("timestamp")).alias("us"))


same("tm_date_literals", "select date '2024-02-29' as leap, date '2024-03-01' > date '2024-02-29' as later")


@query("collate_compare", "select n_name as k, n_name < 'M' as a, lower(n_name) = lower('GERMANY') as b from nation")
def collate_compare(spark, sf_dir):
    return parquet(spark, sf_dir, "nation").select(col("n_name").alias("k"), (F.collate(col("n_name"), "UTF8_BINARY") < "M").alias("a"), (F.collate(col("n_name"), "UTF8_LCASE") == F.collate(lit("GERMANY"), "UTF8_LCASE")).alias("b"))
