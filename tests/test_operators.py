"""Edges of the function and operator libraries that no table query shows."""

import datetime
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestra.functions import arrays, jsonpath, jsons, misc, numeric, ranges, regex, temporal, text
from lodestra.operators import aggregates, dml, joins, recursive, tables, windows
from lodestra.plans import explain
from lodestra.plans.session import Engine, sqlstate
from lodestra.sources import catalog, readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, state",
    [
        (lambda: numeric.int_div(F.lit(1), F.lit(0)), "22012"),
        (lambda: numeric.ln(F.lit(0.0)), "2201E"),
        (lambda: numeric.sqrt(F.lit(-1.0)), "2201F"),
        (lambda: numeric.checked(F.exp(F.lit(1000.0))), "22003"),
        (lambda: numeric.asin(F.lit(2.0)), "22003"),
        (lambda: numeric.factorial(F.lit(40)), "22003"),
        (lambda: text.substr(F.lit("a"), 1, -1), "22011"),
        (lambda: text.chr_(F.lit(0)), "22023"),
        (lambda: ranges.numrange(F.lit(2.0), F.lit(1.0)), "22000"),
        (lambda: ranges.union(ranges.i32range(F.lit(1), F.lit(2)), ranges.i32range(F.lit(5), F.lit(6))), "22000"),
        (lambda: jsons.array_length(F.lit("{}")), "22023"),
    ],
)
def test_domain_errors(spark, make, state):
    with pytest.raises(PySparkException) as e:
        one(spark, make())
    assert sqlstate(e.value) == state


def test_integers_truncate_towards_zero(spark):
    for a, b in [(7, 2), (-7, 2), (7, -2), (-7, -2), (0, 5)]:
        assert one(spark, numeric.int_div(F.lit(a), F.lit(b))) == int(a / b)
    assert one(spark, numeric.gcd(F.lit(0), F.lit(0))) == 0
    assert one(spark, numeric.gcd(F.lit(12), F.lit(-18))) == 6
    assert one(spark, numeric.lcm(F.lit(4), F.lit(6))) == 12


def test_strings_in_functions(spark):
    assert one(spark, text.left(F.lit("abc"), -5)) == ""
    assert one(spark, text.right(F.lit("abc"), 0)) == ""
    assert one(spark, text.quote_literal(F.lit("a\\b"))) == " E'a\\\\b'"
    assert one(spark, text.quote_ident(F.lit('A"b'))) == '"A""b"'


def test_regex_end_is_the_very_end(spark):
    assert one(spark, regex.matches(F.lit("a\n"), "a$")) is False
    assert one(spark, regex.matches(F.lit("a$"), r"a\$")) is True
    assert one(spark, regex.regexp_replace(F.lit("aXbX"), "X", r"[\&]")) == "a[X]bX"
    assert one(spark, regex.regexp_match(F.lit("foobar"), "(o+)(b)")) == ["oo", "b"]
    assert one(spark, regex.regexp_match(F.lit("foobar"), "z")) is None


def test_intervals(spark):
    i = temporal.make_interval(years=1, months=2, weeks=1, days=3, hours=4, mins=5, secs=6.5)
    assert tuple(one(spark, i)) == (14, 10, 14706500000)
    assert one(spark, temporal.date_part_interval("hour", i)) == 4
    with pytest.raises(ValueError, match="22023"):
        temporal.extract("fortnight", F.lit("2020-01-01").cast("date"))
    d = temporal.difference(F.lit("2020-01-02 01:00:00").cast("timestamp_ntz"), F.lit("2020-01-03 02:00:00").cast("timestamp_ntz"))
    assert tuple(one(spark, d)) == (0, -1, -3600000000)


def test_arrays(spark):
    a = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    kind = T.ArrayType(T.ArrayType(T.IntegerType()))
    assert one(spark, arrays.ndims(a, kind)) == 2
    assert one(spark, arrays.dims(a, 2)) == "[1:2][1:2]"
    assert one(spark, arrays.cardinality(a, 2)) == 4
    empty = F.array().cast("array<int>")
    assert one(spark, arrays.length(empty)) is None
    assert one(spark, arrays.cat(F.lit(None).cast("array<int>"), F.array(F.lit(1)))) == [1]
    assert one(spark, arrays.any_of(F.array(F.lit(1), F.lit(None).cast("int")), lambda x: x == 2)) is None


def test_jsonpath():
    doc = {"a": [1, 2, {"b": None}], "s": "xyz"}
    run = lambda p: jsonpath.evaluate(jsonpath.parse(p), doc)
    assert run("$.a[0 to 1]") == [1, 2]
    assert run("$.a[*].b") == [None]
    assert run("$.*")[1] == "xyz"
    assert run('$ ? (@.s starts with "xy").a.size()') == [3]
    assert run('$.s ? (@ like_regex "^x")') == ["xyz"]
    assert run("$.a[*] ? (exists(@.b))") == [{"b": None}]
    with pytest.raises(jsonpath.PathError):
        run("strict $.zz")
    with pytest.raises(jsonpath.PathError):
        jsonpath.parse("$.a[")


def test_json_contains(spark):
    hold = lambda a, b: one(spark, jsons.contains(F.lit(a), F.lit(b)))
    assert hold('{"a": [1, {"b": 2}]}', '{"a": [{"b": 2}]}')
    assert hold("[1, 2]", "1")
    assert not hold("1", "[1]")
    assert not hold('{"a": 1}', '{"a": true}')


def test_recursion_ends_on_cycles_and_at_the_ceiling(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    start = spark.createDataFrame([(1,)], "n int")
    found = recursive.fixpoint(start, lambda w: w.join(edges, w.n == edges.a).select(F.col("b").alias("n")))
    assert sorted(r.n for r in found.collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError, match="54P01"):
        recursive.fixpoint(start, lambda w: w.selectExpr("n + 1 as n"), ceiling=3)


def test_quantified_subqueries_with_nulls(spark):
    outer = spark.createDataFrame([(1,), (5,)], "x int")
    inner = spark.createDataFrame([(2,), (None,)], "y int")
    assert [r.x for r in joins.compared(outer, inner, "x", "<", "y", "any").collect()] == [1]
    assert joins.compared(outer, inner, "x", ">", "y", "all").count() == 0
    assert joins.compared(outer, inner.where("y > 9"), "x", ">", "y", "all").count() == 2


def test_hypothetical_on_an_empty_group(spark):
    empty = spark.createDataFrame([], "v int")
    v, c = F.lit(3), F.col("v")
    row = empty.agg(aggregates.rank_of(v, c).alias("r"), aggregates.dense_rank_of(v, c).alias("d"), aggregates.percent_rank_of(v, c).alias("p"), aggregates.cume_dist_of(v, c).alias("c")).first()
    assert tuple(row) == (1, 1, 0.0, 1.0)
    assert empty.agg(aggregates.percentile_disc(c, 0.5).alias("x")).first().x is None


def test_series(spark):
    s = lambda *a, **k: one(spark, tables.generate_series(*[F.lit(x).cast("bigint") for x in a], **k))
    assert s(3, 1) == [] and s(1, 3) == [1, 2, 3] and s(5, 1, step=-2) == [5, 3, 1]
    with pytest.raises(ValueError, match="22023"):
        tables.generate_series(F.lit(1), F.lit(2), 0)


def test_upsert_where_and_null_keys(spark):
    t = spark.createDataFrame([(1, 10), (None, 20)], "k int, v int")
    new = spark.createDataFrame([(1, 5), (None, 6)], "k int, v int")
    c = dml.insert_on_conflict(t, new, ["k"], {"v": F.col("excluded_v")}, F.col("excluded_v") > F.col("v"))
    assert sorted((r.k or 0, r.v) for r in c.table.collect()) == [(0, 6), (0, 20), (1, 10)]
    assert [(r.k, r.v) for r in c.returning.collect()] == [(None, 6)]


def test_exclusions_brute_force(spark):
    """Floats and infinities stay exact; every function and exclusion, with and without bounds."""
    rows = [(1, 1, 0.1), (1, 1, 0.2), (1, 2, 0.3), (1, 3, float("inf")), (1, 3, None), (2, 1, None), (2, 5, -1.5), (2, 5, -1.5), (2, 6, 1e300)]
    t = windows.numbered(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p int, o int, v double"), ["p"], [F.col("o")])
    fns = {F.sum: sum, F.count: len, F.min: min, F.max: max, F.avg: lambda x: sum(x) / len(x)}
    for low, high in ((None, None), (-1, 1), (0, None)):
        got = t.select("i", *(windows.excluding(F.col("v"), what, ["p"], fn, low, high).alias(f"{what}/{fn.__name__}") for what in ("no others", "current row", "group", "ties") for fn in fns)).collect()
        for r in got:
            p, o, v = rows[r.i]
            group = {x: k for k, x in enumerate(sorted({y[1] for y in rows if y[0] == p}))}
            frame = [j for j, y in enumerate(rows) if y[0] == p and (low is None or group[y[1]] - group[o] >= low) and (high is None or group[y[1]] - group[o] <= high)]
            peers = [j for j in frame if rows[j][1] == o]
            for what, out in {"no others": [], "current row": [r.i], "group": peers, "ties": [j for j in peers if j != r.i]}.items():
                held = [rows[j][2] for j in frame if j not in out and rows[j][2] is not None]
                for fn, plain in fns.items():
                    want = plain(held) if held or plain is len else None
                    assert r[f"{what}/{fn.__name__}"] == want or want is not None and abs(r[f"{what}/{fn.__name__}"] - want) < 1e-12, (what, fn, r.i)


def test_repeated_proposals(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (3, "w"), (None, "n"), (None, "n")], "k int, v string").coalesce(1)
    c = dml.insert_on_conflict(t, new, ["k"])
    assert sorted(((r.k or 0, r.v) for r in c.table.collect())) == [(0, "n"), (0, "n"), (1, "a"), (3, "z")]
    with pytest.raises(Exception, match="21000"):
        dml.insert_on_conflict(t, new, ["k"], {"v": F.col("excluded_v")}).table.collect()
    once = dml.insert_on_conflict(t, new.where("v in ('x', 'z', 'n')"), ["k"], {"v": F.col("excluded_v")})
    assert sorted((r.k or 0, r.v) for r in once.table.collect()) == [(0, "n"), (0, "n"), (1, "x"), (3, "z")]


def test_json_numbers_keep_their_digits(spark):
    say = lambda c: one(spark, c)
    lit = F.lit
    assert say(jsons.canonical(lit("12345678901234567890.123"))) == "12345678901234567890.123"
    assert say(jsons.canonical(lit("1e2"))) == say(jsons.canonical(lit("100.0"))) == "100"
    assert say(jsons.canonical(lit("12345678901234567890.1"))) != say(jsons.canonical(lit("12345678901234567890.2")))
    assert say(jsons.strip_nulls(lit('{"a": 1.50, "b": null}'))) == '{"a": 1.50}'
    assert say(jsons.contains(lit('{"a": 1.0}'), lit('{"a": 1}')))
    assert say(jsons.path_query_array(lit('{"a": [0.1, 0.30, 2]}'), "$.a[*] ? (@ > 0.2)")) == "[0.30, 2]"
    assert say(jsons.is_json(lit('{"a": 1, "a": 2}'))) and not say(jsons.is_json(lit('{"a": 1, "a": 2}'), unique_keys=True)) and not say(jsons.is_json(lit("NaN")))
    assert say(jsons.array_to_json(F.array(lit(1), lit(None)))) == "[1,null]" and say(jsons.array_to_json(F.array(lit(1), lit(2)), True)) == "[1,\n 2]"
    with pytest.raises(Exception, match="22032"):
        say(jsons.serialize(lit("{")))


def test_percentiles_brute_force(spark):
    """Nulls, ties, empty groups, fractions by group, and many ranges."""
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 1.0, 2.5, 7.0, rng.random() * 9]), {1: 0.0, 2: 0.33, None: 1.0, 4: 0.5}[g]) for g in (1, 2, None) for _ in range(rng.randint(1, 40))] + [(4, None, 0.5)]
    df = spark.createDataFrame(rows, "g int, x double, f double")
    cont = {r.g: (r.a, r.b) for r in aggregates.percentiles(df, ["g"], "x", {"a": 0.4, "b": F.col("f")}).collect()}
    disc = {r.g: r.a for r in aggregates.percentiles(df, ["g"], "x", {"a": 0.4}, "disc").collect()}
    for g, f in {(r[0], r[2]) for r in rows}:
        x = sorted(v for k, v, _ in rows if k == g and v is not None)
        at = lambda q: x[int(q * (len(x) - 1))] + (q * (len(x) - 1) % 1) * (x[min(int(q * (len(x) - 1)) + 1, len(x) - 1)] - x[int(q * (len(x) - 1))])
        assert cont[g] == (None, None) if not x else (abs(cont[g][0] - at(0.4)) < 1e-9 and abs(cont[g][1] - at(f)) < 1e-9)
        assert disc[g] == (x[max(1, math.ceil(0.4 * len(x))) - 1] if x else None)
    with pytest.raises(Exception, match="22003"):
        aggregates.percentiles(df.withColumn("g", F.lit(1)), ["g"], "x", {"a": F.col("f")}).collect()


def test_sequences_and_clock(spark):
    engine = Engine(spark, clock=lambda: datetime.datetime(2020, 1, 2, 3))
    with pytest.raises(ValueError, match="55000"):
        engine.lastval()
    engine.create_sequence("a")
    engine.create_sequence("b", 10)
    assert [engine.nextval("a"), engine.nextval("b"), engine.nextval("a"), engine.lastval(), engine.currval("b")] == [1, 10, 2, 2, 10]
    assert engine.setval("b", 40) == 40 and engine.nextval("b") == 41 and engine.lastval() == 41
    assert engine.spark.range(1).select(engine.now().cast("string")).first()[0] == "2020-01-02 03:00:00"
    day = lambda w: one(spark, temporal.special_date(w, F.lit("2024-02-29").cast("date")))
    assert [str(day(w)) for w in ("today", "tomorrow", "yesterday", "epoch")] == ["2024-02-29", "2024-03-01", "2024-02-28", "1970-01-01"]


def test_files_and_renderers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k int, t string").coalesce(1)
    sinks.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, readers.csv(spark, f"{tmp_path}/c", "k int, t string").collect())) == [(1, 'a "b", c'), (2, None)]
    sinks.write_json(df, f"{tmp_path}/j")
    assert readers.json_lines(spark, f"{tmp_path}/j", "k int, t string").count() == 2
    assert "CREATE TABLE x (`k` int, `t` string)" in sinks.dump(df, f"{tmp_path}/p", "x")
    assert sinks.aligned(df).splitlines()[-1] == "(2 rows)"
    assert sinks.box(df).startswith("┌") and sinks.markdown(df).splitlines()[1] == "| --- | --- |"
    assert sinks.csv_text(df) == 'k,t\n1,"a ""b"", c"\n2,\n' and '"k": 1' in sinks.json_text(df)


def test_engine_session(spark, small):
    e = Engine(spark)
    e.attach(small)
    assert e.sql("select count(*) as n from nation where n_regionkey = :r", {"r": 1}).first().n == 5
    e.register("twice", lambda s: s * 2, "bigint")
    assert e.sql("select twice(21L) as x").first().x == 42
    e.grant("select", "region")
    with pytest.raises(PermissionError, match="42501"):
        e.sql("select * from nation")
    assert len(list(e.cursor("select * from region"))) == 5
    with pytest.raises(PySparkException) as x:
        e.sql("select 1 div 0 as x").collect()
    assert sqlstate(x.value) == "22012"
    s = e.create_sequence("s", 10, 5)
    with pytest.raises(ValueError, match="55000"):
        s.currval()
    assert (s.nextval(), s.nextval(), s.currval(), s.setval(3, called=False), s.nextval()) == (10, 15, 15, 3, 3)
    assert e.create_type("pair", "a:int,b:string") == "struct<a:int,b:string>"
    with pytest.raises(KeyError, match="42704"):
        misc.Settings().current("nope")


def test_introspection(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert ("three", True) in {(r.table_name, r.temporary) for r in catalog.sys_tables(spark).collect()}
    assert catalog.sys_constraints(spark, {"t": [("check", "a > 0")]}).first().definition == "a > 0"
    assert explain.explain_rows(spark.range(3).filter("id > 1")).where("node = 'Filter'").count() == 1
