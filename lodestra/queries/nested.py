"""Arrays, ranges, records, JSON and set-returning functions."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestra.functions import arrays as ar
from lodestra.functions import jsons as js
from lodestra.functions import misc
from lodestra.functions import ranges as rg
from lodestra.operators import aggregates as agg
from lodestra.operators import tables as tb
from lodestra.queries.base import both
from lodestra.registry import query
from lodestra.sources.readers import parquet

col, lit = F.col, F.lit


def _lines(spark, sf_dir):
    """Per order k the sorted line numbers xs and part keys modulo 7 ps (with repeats)."""
    li = parquet(spark, sf_dir, "lineitem")
    return li.groupBy(col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("xs"), F.array_sort(F.collect_list(col("l_partkey") % 7)).alias("ps"))


_LINES = "(select l_orderkey as k, list_sort(list(l_linenumber)) as xs, list_sort(list(l_partkey % 7)) as ps from lineitem group by 1) t"


@query("arr_introspection", f"select k, 1 as n, len(xs) as l, 1 as lo, len(xs) as hi, len(xs) as c, '[1:' || len(xs) || ']' as d from {_LINES}")
def arr_introspection(spark, sf_dir):
    x = col("xs")
    return _lines(spark, sf_dir).select("k", ar.ndims(x, T.ArrayType(T.IntegerType())).alias("n"), ar.length(x).alias("l"), ar.lower(x).alias("lo"), ar.upper(x).alias("hi"), ar.cardinality(x).alias("c"), ar.dims(x).alias("d"))


@query("arr_edit", f"""select k, list_append(ps, 9) as a, list_prepend(9, ps) as b, list_concat(ps, xs) as c, list_filter(ps, lambda x: x <> 3) as d,
    list_transform(ps, lambda x: case when x = 3 then 30 else x end) as e from {_LINES}""")
def arr_edit(spark, sf_dir):
    p = col("ps")
    return _lines(spark, sf_dir).select("k", F.array_append(p, lit(9)).alias("a"), F.array_prepend(p, lit(9)).alias("b"), ar.cat(p, col("xs").cast("array<bigint>")).alias("c"), ar.remove(p, lit(3)).alias("d"), ar.replace(p, lit(3), lit(30)).alias("e"))


@query("arr_search", f"""select k, nullif(list_position(ps, 3), 0) as p, list_filter(list_transform(range(1, len(ps) + 1), lambda i: case when ps[i] = 3 then i end), lambda i: i is not null) as places,
    list_has_all(ps, [1, 2]) as c, list_has_any(ps, [1, 2]) as o, list_has_all([0, 1, 2, 3], ps) as b from {_LINES}""")
def arr_search(spark, sf_dir):
    p, two = col("ps"), F.array(lit(1), lit(2))
    return _lines(spark, sf_dir).select("k", ar.position(p, lit(3)).alias("p"), ar.positions(p, lit(3)).alias("places"), ar.contains(p, two).alias("c"), ar.overlaps(p, two).alias("o"), ar.contains(F.array(*map(lit, range(4))), p).alias("b"))


@query("arr_subscript_slice", f"select k, xs[2] as a, xs[99] as b, xs[2:3] as s, [xs[1], 7] as n from {_LINES}")
def arr_subscript(spark, sf_dir):
    x = col("xs")
    return _lines(spark, sf_dir).select("k", ar.item(x, 2).alias("a"), ar.item(x, 99).alias("b"), ar.slice_(x, 2, 3).alias("s"), F.array(ar.item(x, 1), lit(7)).alias("n"))


@query("arr_compare", f"select k, xs = [1, 2] as e, xs < [1, 3] as l from {_LINES}")
def arr_compare(spark, sf_dir):
    return _lines(spark, sf_dir).select("k", (col("xs") == F.array(lit(1), lit(2))).alias("e"), (col("xs") < F.array(lit(1), lit(3))).alias("l"))


@query("arr_null_matching", "select * from (values (2, [1, 3], [2], true)) t(p, r, ps, a)")
def arr_nulls(spark, sf_dir):
    a = F.array(lit(1), lit(None).cast("int"), lit(3))
    n = lit(None).cast("int")
    return spark.range(1).select(ar.position(a, n).alias("p"), ar.remove(a, n).alias("r"), ar.positions(a, n).alias("ps"), ar.any_of(a, lambda x: x == 3).alias("a"))


@query("arr_gin_scan", "select k from (select l_orderkey as k, list(l_linenumber) as xs from lineitem group by 1) t where list_has_all(xs, [5, 6])")
def arr_gin(spark, sf_dir):
    t = parquet(spark, sf_dir, "lineitem").groupBy(col("l_orderkey").alias("k")).agg(F.collect_list("l_linenumber").alias("xs"))
    return t.where(ar.contains(col("xs"), F.array(lit(5), lit(6)))).select("k")


@query("arr_embedding_scan", "select vec_id, len(embedding) as n, round(embedding[1], 5) as f, embedding[1] > 0.5 as b from embeddings")
def arr_embedding(spark, sf_dir):
    e = col("embedding")
    return parquet(spark, sf_dir, "embeddings").select("vec_id", F.size(e).alias("n"), F.round(ar.item(e, 1), 5).alias("f"), (ar.item(e, 1) > 0.5).alias("b"))


@query("row_types", "select n_nationkey as k, n_name as a, n_regionkey + 1 as b from nation")
def row_types(spark, sf_dir):
    n = parquet(spark, sf_dir, "nation").select("n_nationkey", F.struct(col("n_name").alias("a"), (col("n_regionkey") + 1).alias("b")).alias("r"))
    return n.select(col("n_nationkey").alias("k"), "r.*")


# Ranges


def _spans(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders")
    a, b = col("o_custkey") % 20, col("o_orderkey") % 15
    return o.select(col("o_orderkey").alias("k"), a.alias("a"), b.alias("b"), rg.i64range(a, a + 5).alias("r"), rg.i64range(b, b + 4, "(]").alias("s"))


_SPANS = "(select o_orderkey as k, o_custkey % 20 as a, o_custkey % 20 + 5 as ah, o_orderkey % 15 + 1 as b, o_orderkey % 15 + 5 as bh from orders) t"


@query("rng_accessors", f"select k, a as lo, ah as hi, true as li, false as ui, false as e, false as f, b as sl, bh as sh from {_SPANS}")
def rng_accessors(spark, sf_dir):
    r, s = col("r"), col("s")
    return _spans(spark, sf_dir).select("k", r["lower"].alias("lo"), r["upper"].alias("hi"), r["lower_inc"].alias("li"), r["upper_inc"].alias("ui"), r["empty"].alias("e"), rg.lower_inf(r).alias("f"), s["lower"].alias("sl"), s["upper"].alias("sh"))


@query("rng_operators", f"""select k, a <= b and ah >= bh as c, b <= a and bh >= ah as d, a <= 7 and 7 < ah as v, a < bh and b < ah as o, ah <= b as l, a >= bh as r,
    ah <= bh as nr, a >= b as nl, ah = b or bh = a as j from {_SPANS}""")
def rng_operators(spark, sf_dir):
    r, s = col("r"), col("s")
    return _spans(spark, sf_dir).select(
        "k", rg.contains(r, s).alias("c"), rg.contains(s, r).alias("d"), rg.contains_value(r, lit(7)).alias("v"), rg.overlaps(r, s).alias("o"), rg.strictly_left(r, s).alias("l"), rg.strictly_right(r, s).alias("r"),
        rg.not_extend_right(r, s).alias("nr"), rg.not_extend_left(r, s).alias("nl"), rg.adjacent(r, s).alias("j"),
    )


@query("rng_set_operations", f"""select k, least(a, b) as ml, greatest(ah, bh) as mh, case when a < bh and b < ah then greatest(a, b) end as il, case when a < bh and b < ah then least(ah, bh) end as ih,
    '[' || least(a, b) || ',' || greatest(ah, bh) || ')' as t from {_SPANS} where a <= bh and b <= ah""")
def rng_sets(spark, sf_dir):
    t = _spans(spark, sf_dir)
    t = t.where(rg.overlaps(col("r"), col("s")) | rg.adjacent(col("r"), col("s")))
    m, i = rg.merge(col("r"), col("s")), rg.intersection(col("r"), col("s"))
    return t.select("k", m["lower"].alias("ml"), m["upper"].alias("mh"), i["lower"].alias("il"), i["upper"].alias("ih"), rg.text(rg.union(col("r"), col("s"))).alias("t"))


@query("rng_difference", f"select k, case when b <= a then bh else a end as l, case when b <= a then ah else b end as h from {_SPANS} where a < bh and b < ah and not (a < b and bh < ah) and not (b <= a and bh >= ah)")
def rng_difference(spark, sf_dir):
    t = _spans(spark, sf_dir).where(rg.overlaps(col("r"), col("s")) & ~((col("r.lower") < col("s.lower")) & (col("s.upper") < col("r.upper"))) & ~rg.contains(col("s"), col("r")))
    d = rg.difference(col("r"), col("s"))
    return t.select("k", d["lower"].alias("l"), d["upper"].alias("h"))


@query("rng_bounds_and_empties", "select * from (values ('[1,6)', 'empty', '(,5)', '[2,)', '(1.5,2.5]', '[2024-01-02,2024-01-05)', true)) t(a, b, c, d, e, f, g)")
def rng_bounds(spark, sf_dir):
    none = lit(None).cast("int")
    d = lambda x: lit(x).cast("decimal(3,1)")
    return spark.range(1).select(
        rg.text(rg.i32range(lit(1), lit(5), "[]")).alias("a"), rg.text(rg.i32range(lit(3), lit(3))).alias("b"), rg.text(rg.i32range(none, lit(5))).alias("c"), rg.text(rg.i32range(lit(2), none)).alias("d"),
        rg.text(rg.numrange(d("1.5"), d("2.5"), "(]")).alias("e"), rg.text(rg.daterange(lit("2024-01-01"), lit("2024-01-04"), "(]")).alias("f"), rg.lower_inf(rg.i32range(none, lit(5))).alias("g"),
    )


@query("rng_timestamps", "select o_orderkey as k, o_orderdate <= timestamp '1995-06-01' and timestamp '1995-06-01' < o_orderdate + interval 400 day as c from orders")
def rng_timestamps(spark, sf_dir):
    t = col("o_orderdate")
    r = rg.tsrange(t, t + F.expr("interval 400 days"))
    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), rg.contains_value(r, lit("1995-06-01").cast("timestamp_ntz")).alias("c"))


# JSON over events.props

_K = "cast(event_id as bigint) as k"


def _events(spark, sf_dir):
    return parquet(spark, sf_dir, "events").select(col("event_id").alias("k"), col("props").alias("j"))


@query("json_access", "select event_id as k, json_type(props) = 'OBJECT' as o, json_keys(props) as ks, json_extract_string(props, '$.' || json_keys(props)[1]) as v from events")
def json_access(spark, sf_dir):
    t = _events(spark, sf_dir).withColumn("m", F.from_json("j", "map<string,string>")).withColumn("ks", F.json_object_keys("j"))
    return t.select("k", (js.typeof(col("j")) == "object").alias("o"), "ks", F.element_at("m", F.get("ks", lit(0))).alias("v"))


_DOC = '{"a": {"b": [1, 2, {"c": "x"}]}, "n": null, "s": "t", "f": 1.5, "ok": true}'


def _doc(spark):
    return spark.range(1).select(lit(_DOC).alias("j"))


@query("json_operators", """select * from (values ('{"b":[1,2,{"c":"x"}]}', 't', 'x', '[1,2,{"c":"x"}]', true, false, true, true, false)) t(a, s, p, q, h, i, y, z, w)""")
def json_operators(spark, sf_dir):
    j = col("j")
    return _doc(spark).select(
        js.get(j, "a").alias("a"), js.get_text(j, "s").alias("s"), js.get_text(j, "a", "b", 2, "c").alias("p"), js.get_path(j, ["a", "b"]).alias("q"), js.has_key(j, "n").alias("h"), js.has_key(j, "zz").alias("i"),
        js.has_any(j, ["zz", "s"]).alias("y"), js.has_all(j, ["a", "s"]).alias("z"), js.has_all(j, ["a", "zz"]).alias("w"),
    )


@query("json_typeof_and_test", "select * from (values ('object', true, true, false), ('array', true, false, false), ('number', true, false, true), ('string', true, false, true), ('null', true, false, true)) t(t, v, o, s)")
def json_typeof(spark, sf_dir):
    t = spark.createDataFrame([("{}",), ("[1]",), ("1",), ('"a"',), ("null",)], "j string")
    j = col("j")
    return t.select(js.typeof(j).alias("t"), js.is_json(j).alias("v"), js.is_json(j, "object").alias("o"), js.is_json(j, "scalar").alias("s"))


@query("json_edit", """select * from (values ('{"a": {"b": [1, 2, {"c": "x"}]}, "f": 1.5, "s": "t", "ok": true}', '{"a": {"b": [1, 2, {"c": "x"}]}, "f": 1.5, "n": null, "ok": true}', '[1, 9, 2]', '[1, 7]', '{"x": 1, "y": 2}', '[1, 2, 3]')) t(a, b, c, d, e, f)""")
def json_edit(spark, sf_dir):
    j = col("j")
    s = lambda x: lit(x)
    return _doc(spark).select(js.strip_nulls(j).alias("a"), js.delete(j, "s").alias("b"), js.insert(s("[1, 2]"), ["1"], "9").alias("c"), js.set_(s("[1, 2]"), ["1"], "7").alias("d"), js.concat(s('{"x": 1}'), s('{"y": 2}')).alias("e"), js.concat(s("[1, 2]"), s("[3]")).alias("f"))


@query("json_containment", """select o_orderkey as k, o_custkey % 3 = 1 as a, o_custkey % 5 = 2 or o_orderkey % 7 = 2 as b, o_custkey % 3 = 1 and (o_custkey % 5 = 4 or o_orderkey % 7 = 4) as c, true as d from orders""")
def json_containment(spark, sf_dir):
    j = F.to_json(F.struct((col("o_custkey") % 3).alias("a"), F.array(col("o_custkey") % 5, col("o_orderkey") % 7).alias("b")))
    t = parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), j.alias("j"))
    has = lambda x: js.contains(col("j"), lit(x))
    return t.select("k", has('{"a": 1.0}').alias("a"), has('{"b": [2]}').alias("b"), has('{"b": [4, 4], "a": 1}').alias("c"), has("{}").alias("d"))


@query("json_arrays_and_lengths", """select o_orderkey as k, '[' || o_custkey % 5 || ',' || case when o_orderkey % 3 = 0 then 'null' else cast(o_orderkey % 3 as varchar) end || ']' as a, 2 as n, o_orderkey % 3 = 0 as u, upper(o_orderstatus) as s from orders""")
def json_arrays(spark, sf_dir):
    third = F.when(col("o_orderkey") % 3 != 0, col("o_orderkey") % 3)
    t = parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), js.array_to_json(F.array(col("o_custkey") % 5, third)).alias("a"), F.when(col("o_orderkey") % 3 == 0, lit('{"x":1,"y":2}')).otherwise(lit('{"x":1,"x":2}')).alias("j"), js.scalar(col("o_orderstatus")).alias("q"))
    return t.select("k", "a", js.array_length(js.serialize(col("a"))).alias("n"), js.is_json(col("j"), unique_keys=True).alias("u"), F.btrim("q", lit('"')).alias("s"))


@query("srf_json_path_query", """select k, e from (select o_orderkey as k, unnest([o_custkey % 5, o_orderkey % 7, 9]) as e from orders) t where e > 2""")
def srf_json_path_query(spark, sf_dir):
    j = F.to_json(F.struct(F.array(col("o_custkey") % 5, col("o_orderkey") % 7, lit(9).cast("bigint")).alias("p")))
    t = parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), j.alias("j"))
    return tb.json_path_query(t, col("j"), "$.p[*] ? (@ > 2)", "e").select("k", col("e").cast("bigint").alias("e"))


@query("srf_json_elements_text", "select n_nationkey as k, unnest([n_name, cast(n_regionkey as varchar)]) as e from nation")
def srf_json_elements_text(spark, sf_dir):
    t = parquet(spark, sf_dir, "nation").select(col("n_nationkey").alias("k"), js.build_array(col("n_name"), col("n_regionkey")).alias("j"))
    return tb.json_array_elements(t, col("j"), "e", text=True).select("k", "e")


@query("json_builders", "select n_nationkey as k, '[' || n_nationkey || ', \"' || n_name || '\"]' as a, '{\"id\": ' || n_nationkey || ', \"name\": \"' || n_name || '\"}' as o, '{\"k\":\"' || n_name || '\"}' as m from nation")
def json_builders(spark, sf_dir):
    n = parquet(spark, sf_dir, "nation")
    return n.select(col("n_nationkey").alias("k"), js.build_array(col("n_nationkey"), col("n_name")).alias("a"), js.build_object(id=col("n_nationkey"), name=col("n_name")).alias("o"), js.object_of(F.array(lit("k")), F.array(col("n_name"))).alias("m"))


@query("json_path_language", """select * from (values (true, false, '[1, 2, {"c": "x"}]', '"x"', '[2]', true, '[{"c": "x"}]', '"object"')) t(a, b, c, d, e, f, g, h)""")
def json_path(spark, sf_dir):
    j = col("j")
    return _doc(spark).select(
        js.path_exists(j, "$.a.b[*] ? (@ > 1)").alias("a"), js.path_exists(j, "strict $.zz").alias("b"), js.path_query_array(j, "$.a.b[*]").alias("c"), js.path_query_first(j, "$.a.b[2].c").alias("d"),
        js.path_query_array(j, "$.a.b[*] ? (@ > 1 && @ < 3)").alias("e"), js.path_match(j, '$.s == "t"').alias("f"), js.path_query_array(j, "$.a.b[last]").alias("g"), js.path_query_first(j, "$.a.type()").alias("h"),
    )


@query("json_sql_functions", """select * from (values ('t', cast(null as varchar), 'none', 1.5, '[1,2,{"c":"x"}]', '["t"]', true)) t(a, b, c, d, e, f, g)""")
def json_sql(spark, sf_dir):
    j = col("j")
    return _doc(spark).select(js.json_value(j, "$.s").alias("a"), js.json_value(j, "$.zz").alias("b"), js.json_value(j, "$.zz", on_empty="none").alias("c"), js.json_value(j, "$.f", "double").alias("d"), js.json_query(j, "$.a.b").alias("e"), js.json_query(j, "$.s", wrapper=True).alias("f"), js.json_exists(j, "$.a").alias("g"))


@query("json_pretty_canonical", """select * from (values ('{
    "b": 1,
    "aa": [
        2
    ]
}', '{"b": 1, "aa": [2]}')) t(p, c)""")
def json_pretty(spark, sf_dir):
    return spark.range(1).select(js.pretty(lit('{"aa":[2],"b":1}')).alias("p"), js.canonical(lit('{"aa":[2],"b":1}')).alias("c"))


@query("json_agg_nulls", """select * from (values ('[1,2,null]', '[1,2]')) t(a, s)""")
def json_agg_nulls(spark, sf_dir):
    t = spark.sql("select x, case when x is null then 9 else x end as o from values (1), (2), (cast(null as int)) t(x)")
    return t.agg(F.regexp_replace(F.concat(lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: F.coalesce(s["x"].cast("string"), lit("null"))), ","), lit("]")), " ", "").alias("a"), agg.json_agg(col("x"), strict=True).alias("s"))


# Set-returning functions

both("srf_generate_series", "select explode(sequence(1, 10, 3)) as n", "select unnest(generate_series(1, 10, 3)) as n")


@query("srf_generate_series_lateral", "select n_nationkey as k, g as n from nation, unnest(generate_series(n_regionkey, 3)) u(g)")
def srf_series(spark, sf_dir):
    n = parquet(spark, sf_dir, "nation")
    return n.select(col("n_nationkey").alias("k"), F.explode(tb.generate_series(col("n_regionkey").cast("bigint"), lit(3).cast("bigint"))).alias("n"))


@query("srf_unnest", f"select k, unnest(ps) as p from {_LINES}")
def srf_unnest(spark, sf_dir):
    return tb.unnest(_lines(spark, sf_dir), col("ps"), "p").select("k", "p")


@query("srf_unnest_composite", "select l_orderkey as k, l_linenumber as n, l_quantity as q from lineitem")
def srf_composite(spark, sf_dir):
    t = parquet(spark, sf_dir, "lineitem").groupBy(col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(col("l_linenumber").alias("n"), col("l_quantity").alias("q"))).alias("a"))
    return t.select("k", F.inline("a"))


@query("srf_json_array_elements", """select * from (values (1, '1'), (1, '{"c":2}'), (1, '"x"')) t(k, e)""")
def srf_json_array(spark, sf_dir):
    t = spark.range(1).select(lit(1).alias("k"), lit('[1, {"c": 2}, "x"]').alias("j"))
    return tb.json_array_elements(t, col("j"), "e").select("k", "e")


@query("srf_json_keys_and_each", "select event_id as k, unnest(json_keys(props)) as key from events")
def srf_json_keys(spark, sf_dir):
    return tb.json_object_keys(_events(spark, sf_dir), col("j"), "key").select("k", "key")


@query("srf_json_each_text", "select k, key, json_extract_string(props, '$.' || key) as value from (select event_id as k, props, unnest(json_keys(props)) as key from events) t")
def srf_json_each(spark, sf_dir):
    return tb.json_each_text(_events(spark, sf_dir), col("j")).select("k", "key", "value")


@query("srf_json_records", "select * from (values (1, 2, 'x', 5), (1, 3, 'y', 6)) t(k, a, b, c)")
def srf_records(spark, sf_dir):
    t = spark.range(1).select(lit(1).alias("k"), lit('[{"a": 2, "b": "x", "c": 5}, {"a": 3, "b": "y", "c": 6}]').alias("j"))
    return tb.json_to_recordset(t, col("j"), "a int, b string, c int").select("k", "a", "b", "c")


@query("srf_json_populate", "select * from (values (7, 'old')) t(a, b)")
def srf_populate(spark, sf_dir):
    r = tb.json_populate(F.struct(lit(1).alias("a"), lit("old").alias("b")), lit('{"a": 7}'), "a int, b string")
    return spark.range(1).select(r.alias("r")).select("r.*")


@query("srf_json_table", "select * from (values (1, 10, 'x', true, 1), (1, 10, 'x', true, 2), (2, 20, null, false, null)) t(n, id, name, has, tag)")
def srf_json_table(spark, sf_dir):
    t = spark.range(1).select(lit('{"rows": [{"id": 10, "name": "x", "tags": [{"t": 1}, {"t": 2}]}, {"id": 20}]}').alias("j"))
    out = tb.json_table(t, col("j"), "$.rows", {"id": ("int", "$.id"), "name": ("string", "$.name"), "has": ("exists", "$.name")}, "n", ("$.tags", {"tag": ("int", "$.t")}))
    return out.select("n", "id", "name", "has", "tag")



# Identifiers and counts


@query("misc_uuid", "select * from (values (4, null), (7, '2024-01-01 00:00:00')) t(v, t)")
def misc_uuid(spark, sf_dir):
    t = spark.createDataFrame([("0b5e7d3c-1a2b-4c3d-8e4f-5a6b7c8d9e0f",), ("018cc251-f400-7c3d-8e4f-5a6b7c8d9e0f",)], "u string")
    return t.select(misc.uuid_version(col("u")).alias("v"), F.date_format(misc.uuid_timestamp(col("u")), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("misc_uuid_generators", "select 36 as a, 36 as b, 4 as v, 7 as w")
def misc_uuid_new(spark, sf_dir):
    t = spark.range(1).select(misc.uuidv4().alias("a"), misc.uuidv7().alias("b"))
    return t.select(F.length("a").alias("a"), F.length("b").alias("b"), misc.uuid_version(col("a")).alias("v"), misc.uuid_version(col("b")).alias("w"))


@query("misc_num_nulls", "select x, (x is null)::int + (y is null)::int as a, (x is not null)::int + (y is not null)::int as b from (values (1, 2), (null, 3), (null, null)) t(x, y)")
def misc_num_nulls(spark, sf_dir):
    t = spark.sql("select x, y from values (1, 2), (cast(null as int), 3), (cast(null as int), cast(null as int)) t(x, y)")
    return t.select("x", misc.num_nulls(col("x"), col("y")).alias("a"), misc.num_nonnulls(col("x"), col("y")).alias("b"))


@query("misc_sequence", "select o_orderkey as k, 100 + 5 * (row_number() over (order by o_orderkey) - 1) as n from orders")
def misc_sequence(spark, sf_dir):
    return misc.Sequence(100, 5).number(parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k")), "n", col("k").asc()).select("k", "n")


@query("misc_settings", "select 'on' as a, cast(null as varchar) as b")
def misc_settings(spark, sf_dir):
    s = misc.Settings({"app.flag": "on"})
    return spark.range(1).select(s.current("app.flag").alias("a"), s.current("app.none", missing_ok=True).cast("string").alias("b"))
