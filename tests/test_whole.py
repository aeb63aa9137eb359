"""Whole tables and groups of many members, where queries were bound to a prefix of ids."""

import pytest
from pyspark.sql import functions as F

from lodestra import queries, registry  # noqa: F401
from lodestra.operators import joins, windows
from lodestra.sources import sinks
from tests.oracle import compare, duck


def test_containment_brute_force(spark):
    arrays = [[1], [1, 2], [2, 1, 1], [1, 2, 3], [], [4], [1, None], [None], None, [2, 3], [5, 4]]
    df = spark.createDataFrame(list(enumerate(arrays)), "k int, xs array<int>")
    a, b = df.select(F.col("k").alias("a"), F.col("xs").alias("ax")), df.select(F.col("k").alias("b"), F.col("xs").alias("bx"))
    found = sorted(tuple(r) for r in joins.containment_join(a, b, "a", "ax", "b", "bx").collect())
    assert found == sorted((i, j) for i, x in enumerate(arrays) for j, y in enumerate(arrays) if x and y and None not in y and set(y) <= set(x))


def test_containment_of_many_equal_arrays(spark):
    """Ten million pairs' keys in one element: only distinct arrays may meet."""
    s = spark.range(100_000).select(F.array(F.lit(1), (2 + F.col("id") % 3).cast("int")).alias("ax"))
    assert joins.containment_classes(s, s.withColumnRenamed("ax", "bx"), "ax", "bx").count() == 3


@pytest.mark.parametrize("name", ["join_range_overlap", "join_array_containment"])
def test_joins_see_all_orders(spark, small, name):
    con = duck(small)
    assert compare(spark, con, small, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""
    last = con.execute("select max(l_orderkey) from lineitem").fetchone()[0]
    assert registry.QUERIES[name](spark, small).agg(F.max("a")).first()[0] > last - 10


def test_containment_whole_stands_for_all_pairs(spark, small):
    pairs = duck(small).execute("with s as (select l_orderkey as k, list(distinct l_linenumber) as xs from lineitem group by 1) select count(*) from s a join s b on list_has_all(a.xs, b.xs)").fetchone()[0]
    assert registry.QUERIES["join_array_containment"](spark, small).agg(F.sum("n")).first()[0] == pairs


@pytest.mark.parametrize("name", ["arr_introspection", "arr_edit", "arr_search", "arr_subscript_slice", "arr_compare", "srf_unnest", "srf_unnest_composite", "rng_accessors", "rng_operators"])
def test_nested_sees_all_rows(spark, name):
    folder = "/root/testdata/sf0.01"  # where ids go beyond every prefix
    con = duck(folder)
    table, key = ("orders", "o_orderkey") if name.startswith("rng") else ("lineitem", "l_orderkey")
    t = registry.QUERIES[name](spark, folder)
    n = con.execute(f"select count({'' if name.startswith('srf') else 'distinct '}{key}), max({key}) from {table}").fetchone()
    assert tuple(t.agg(F.count("k"), F.max("k")).first()) == n


@pytest.mark.parametrize("name", ["rng_set_operations", "rng_difference"])
def test_range_sets_see_all_orders(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duck(folder)
    assert registry.QUERIES[name](spark, folder).where("k >= 2000").count() > 0
    assert compare(spark, con, folder, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", ["kleene_logic", "like_ilike", "case_forms", "quantified_array", "win_range_frame", "sub_any", "sub_all", "num_trigonometry", "num_domain_functions", "num_gcd_lcm_factorial"])
def test_more_queries_see_all_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, duck(folder), folder, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # no OVER () in one task


@pytest.mark.parametrize("inner", [[], [3], [3, 7, 5], [3, None], [None]])
@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "=", "<>"])
@pytest.mark.parametrize("how", ["any", "all"])
def test_compared_brute_force(spark, how, op, inner):
    outer = spark.createDataFrame([(x,) for x in [1, 3, 5, 7, 9, None]], "x int")
    ys = spark.createDataFrame([(y,) for y in inner], "y int")
    condition = F.expr(f"x {op} y")
    sure = (lambda: outer.join(ys, condition, "left_semi")) if how == "any" else (lambda: outer.join(ys, ~condition | condition.isNull(), "left_anti"))
    rows = lambda df: sorted((r.x for r in df.collect()), key=str)
    assert rows(joins.compared(outer, ys, "x", op, "y", how)) == rows(sure())


def test_range_sum_with_nulls_and_gaps(spark):
    rows = [("a", 1, 10), ("a", 2, 20), ("a", 2, 5), ("a", 6, 1), ("a", None, 7), ("a", None, 8), (None, 2, 3), ("b", 3, None)]
    df = spark.createDataFrame(rows, "p string, k int, v int")
    frame = lambda p, k: [v for q, w, v in rows if q == p and v is not None and (k is None and w is None or None not in (k, w) and k - 2 <= w <= k + 1)]
    found = sorted(((r.p, r.k, r.v, r.s) for r in windows.range_sum(df, ["p"], "k", -2, 1, F.col("v"), "s").collect()), key=str)
    assert found == sorted(((p, k, v, sum(frame(p, k)) if frame(p, k) else None) for p, k, v in rows), key=str)


def test_text_sinks_give_all_rows(spark):
    df = spark.range(130).selectExpr("id as k")
    assert sinks.aligned(df).splitlines()[-1] == "(130 rows)" and len(sinks.aligned(df).splitlines()) == 133
    assert sinks.aligned(df, 100).splitlines()[-1] == "(100 rows, stopped)" and sinks.aligned(df, 130).splitlines()[-1] == "(130 rows)"
    assert len(sinks.markdown(df).splitlines()) == 132 and len(sinks.csv_text(df).splitlines()) == 131
    assert len(sinks.box(df).splitlines()) == 134 and sinks.json_text(df).count('"k"') == 130
