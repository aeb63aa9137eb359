"""Statements that change tables, introspection, plans, sources, host functions and event-time windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestra.operators import dml
from lodestra.plans import explain
from lodestra.queries.base import both
from lodestra.registry import query
from lodestra.sources import catalog, readers
from lodestra.sources.readers import parquet
from lodestra.streaming import events as ev

col, lit = F.col, F.lit
_NATION = "n_nationkey as k, n_name as name, n_regionkey as r"


def _nation(spark, sf_dir):
    return parquet(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "n_name as name", "n_regionkey as r")


@query("dml_insert", f"select {_NATION} from nation union all select 100, 'NEW', 9")
def dml_insert(spark, sf_dir):
    return dml.insert(_nation(spark, sf_dir), spark.createDataFrame([(100, "NEW")], "k int, name string"), {"r": lit(9)}).table


@query("dml_insert_select", f"select {_NATION} from nation union all select s_suppkey + 1000, s_name, 0 from supplier")
def dml_insert_select(spark, sf_dir):
    return dml.insert(_nation(spark, sf_dir), parquet(spark, sf_dir, "supplier").select((col("s_suppkey") + 1000).alias("k"), col("s_name").alias("name"), lit(0).alias("r"))).table


@query("dml_conflict_nothing", f"select {_NATION} from nation union all select 50, 'B', 1")
def dml_conflict_nothing(spark, sf_dir):
    return dml.insert_on_conflict(_nation(spark, sf_dir), spark.createDataFrame([(3, "A", 1), (50, "B", 1)], "k int, name string, r int"), ["k"]).table


@query("dml_conflict_update", "select n_nationkey as k, case when n_nationkey = 3 then 'A' else n_name end as name, case when n_nationkey = 3 then n_regionkey + 10 else n_regionkey end as r from nation union all select 50, 'B', 1")
def dml_conflict_update(spark, sf_dir):
    rows = spark.createDataFrame([(3, "A", 10), (50, "B", 1)], "k int, name string, r int")
    return dml.insert_on_conflict(_nation(spark, sf_dir), rows, ["k"], {"name": col("excluded_name"), "r": col("r") + col("excluded_r")}).table


@query("dml_conflict_repeated", f"select {_NATION} from nation union all (select s_nationkey + 20, arg_min(s_name, s_suppkey), 7 from supplier where s_nationkey + 20 not in (select n_nationkey from nation) group by 1)")
def dml_conflict_repeated(spark, sf_dir):
    """Many proposals with one key: the first, by the order of the proposed rows, goes in."""
    rows = parquet(spark, sf_dir, "supplier").orderBy("s_suppkey").select((col("s_nationkey") + 20).alias("k"), col("s_name").alias("name"), lit(7).alias("r"))
    return dml.insert_on_conflict(_nation(spark, sf_dir), rows, ["k"]).table


@query("dml_update", "select n_nationkey as k, case when n_regionkey = 2 then lower(n_name) else n_name end as name, case when n_regionkey = 2 then n_nationkey else n_regionkey end as r from nation")
def dml_update(spark, sf_dir):
    return dml.update(_nation(spark, sf_dir), {"name": F.lower("name"), "r": col("k")}, col("r") == 2).table


@query("dml_update_returning", "select n_nationkey as k, n_name as name, n_regionkey + 1 as r, n_regionkey as old_r from nation where n_nationkey < 5")
def dml_update_returning(spark, sf_dir):
    return dml.update(_nation(spark, sf_dir), {"r": col("r") + 1}, col("k") < 5).returning


@query("dml_delete", f"select {_NATION} from nation where not n_regionkey in (select r_regionkey from region where r_name like 'A%')")
def dml_delete(spark, sf_dir):
    n = _nation(spark, sf_dir)
    gone = parquet(spark, sf_dir, "region").where("r_name like 'A%'").select(col("r_regionkey").alias("r"), lit(True).alias("hit"))
    return dml.delete(n.join(gone, "r", "left").select("k", "name", "r", "hit"), col("hit")).table.drop("hit")


@query("dml_writable_cte", "select 'gone' as what, count(*) as n from nation where n_regionkey = 1 union all select 'left', count(*) from nation where n_regionkey <> 1")
def dml_writable_cte(spark, sf_dir):
    c = dml.delete(_nation(spark, sf_dir), col("r") == 1)
    return c.returning.agg(lit("gone").alias("what"), F.count(lit(1)).alias("n")).unionAll(c.table.agg(lit("left").alias("what"), F.count(lit(1)).alias("n")))


@query("ddl_constraints", "select 'unique' as kind, (select count(*) from (select n_regionkey from nation group by 1 having count(*) > 1) t) as bad union all select 'check', (select count(*) from nation where n_regionkey > 3) union all select 'not null', 0 union all select 'foreign key', (select count(*) from supplier where s_nationkey not in (select n_nationkey from nation where n_nationkey < 20))")
def ddl_constraints(spark, sf_dir):
    n, s = _nation(spark, sf_dir), parquet(spark, sf_dir, "supplier")
    found = {"unique": dml.violations_unique(n, ["r"]), "check": dml.violations_check(n, col("r") <= 3), "not null": dml.violations_not_null(n, ["k", "name"]), "foreign key": dml.violations_foreign_key(s, "s_nationkey", n.where("k < 20"), "k")}
    parts = [df.agg(lit(kind).alias("kind"), F.count(lit(1)).alias("bad")) for kind, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("cat_columns", "select 'nation' as table_name, row_number() over () as ordinal, column_name from (describe nation) t")
def cat_columns(spark, sf_dir):
    readers.attach(spark, sf_dir, tables=["nation"])
    return catalog.sys_columns(spark, "nation").select("table_name", "ordinal", "column_name")


@query("cat_statistics", "select 'o_custkey' as column_name, count(*) as n_rows, count(*) - count(o_custkey) as n_nulls, cast(min(o_custkey) as varchar) as least, cast(max(o_custkey) as varchar) as largest from orders")
def cat_statistics(spark, sf_dir):
    return explain.column_statistics(parquet(spark, sf_dir, "orders"), "o_custkey").select("column_name", "n_rows", "n_nulls", "least", "largest")


@query("cat_common_values", "select o_orderpriority, count(*) as n, round(count(*) / (select count(*) from orders), 8) as share from orders group by 1 order by n desc, 1 limit 3")
def cat_common_values(spark, sf_dir):
    return explain.common_values(parquet(spark, sf_dir, "orders"), "o_orderpriority", 3).withColumn("share", F.round("share", 8))


@query("explain_rows", "select true as scan, true as aggregate")
def explain_rows(spark, sf_dir):
    rows = explain.explain_rows(parquet(spark, sf_dir, "orders").groupBy("o_custkey").count())
    return rows.agg(F.max(col("node").like("%Scan%")).alias("scan"), F.max(col("node").like("%Aggregate%")).alias("aggregate"))


@query("src_attached_folders", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_nationkey = b.n_nationkey")
def src_attached(spark, sf_dir):
    readers.attach(spark, sf_dir, "one", ["nation"])
    readers.attach(spark, sf_dir, "two", ["nation"])
    return spark.sql("select a.n_name as a, b.n_name as b from one_nation a join two_nation b on a.n_nationkey = b.n_nationkey")


@query("udf_host_function", "select o_orderkey as k, round(o_totalprice * 1.1 + o_custkey, 4) as v from orders")
def udf_host(spark, sf_dir):
    @F.pandas_udf("double")
    def host(price: pd.Series, key: pd.Series) -> pd.Series:
        return price * 1.1 + key

    return parquet(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"), F.round(host("o_totalprice", "o_custkey"), 4).alias("v"))


@query("stream_tumbling", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    return ev.tumbling(parquet(spark, sf_dir, "events"))


@query("stream_sliding", "select w as window_start, event_type, count(*) as n, round(sum(value), 2) as total from (select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as w, event_type, value from events) t group by 1, 2")
def stream_sliding(spark, sf_dir):
    return ev.sliding(parquet(spark, sf_dir, "events"))


@query("stream_sessions", """select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n, round(sum(value), 2) as total from
    (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events) a) b group by user_id, s""")
def stream_sessions(spark, sf_dir):
    return ev.sessions(parquet(spark, sf_dir, "events"))


both("bench_hash_join", "select count(*) as n, round(sum(o_totalprice), 2) as s from lineitem join orders on l_orderkey = o_orderkey", "select count(*) as n, round(sum(o_totalprice), 2) as s from lineitem join orders on l_orderkey = o_orderkey")
