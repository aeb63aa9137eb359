"""Scans, filters, joins, aggregates, windows, set operations, subqueries and common table expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestra.functions.ordering import asc, desc
from lodestra.operators import aggregates as agg
from lodestra.operators import joins, recursive, windows
from lodestra.queries.base import both, same
from lodestra.registry import query
from lodestra.sources.readers import parquet

# Scans, projection, filters

same("flagship_pricing_summary", """
    select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_quantity), 6) as avg_qty, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus
    order by l_returnflag nulls last, l_linestatus nulls last""")
same("scan_projection", "select o_orderkey, o_totalprice * 2 as doubled, upper(o_orderpriority) as prio from orders")
same("scan_point_and_range", "select o_orderkey, o_custkey from orders where o_orderkey = 7 or (o_orderkey between 100 and 200 and o_custkey > 10)")
same("scan_in_set", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (1, 5, 9, 300, 1000) and l_linenumber not in (2, 3)")
same("scan_index_order", "select o_orderkey from orders order by o_orderkey limit 25")
same("scan_limit", "select count(*) as n from (select o_orderkey from orders limit 10) t")
same("values_relation", "select a, b from (values (1, 'x'), (2, 'y'), (cast(null as int), 'z')) t(a, b)")
same("from_less_select", "select 1 + 1 as two, 'a' || 'b' as ab")
same("derived_table", "select t.k, t.s from (select o_custkey as k, round(sum(o_totalprice), 2) as s from orders group by o_custkey) t where t.s > 100000")
same("expression_lower_filter", "select count(*) as n from part where lower(p_name) like '%a%'")
same("star_expansion", "select n.*, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey")
same("kleene_logic", """select o_orderkey, (o_custkey > 50 and null) as a, (o_custkey > 50 or null) as b, not (o_custkey > 50) as c
    from orders""")
same("null_tests", """select count(*) as n, count(x) as known, sum(case when x is null then 1 else 0 end) as unknown
    from (select case when o_orderkey % 3 = 0 then null else o_orderkey end as x from orders) t""")
same("distinct_from", """select a, b, a is distinct from b as d, a is not distinct from b as e
    from (values (1, 1), (1, 2), (1, cast(null as int)), (cast(null as int), cast(null as int))) t(a, b)""")
same("in_list_nulls", "select x, x in (1, 2, null) as i, x not in (1, null) as j from (values (1), (2), (3), (cast(null as int))) t(x)")
same("between_filter", "select count(*) as n from lineitem where l_quantity between 10 and 20 and l_discount not between 0.02 and 0.04")
same("like_ilike", "select p_partkey, p_name like 'P%1' as a, p_name ilike 'p%' as b, p_name not like '%2%' as c from part")
same("case_forms", """select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'other' end as s,
    case when o_totalprice > 100000 then 'big' when o_totalprice > 10000 then 'mid' end as size from orders""")
same("coalesce_greatest_least", "select coalesce(a, b, 0) as c, greatest(a, b) as g, least(a, b) as l, nullif(a, b) as n from (values (1, 2), (cast(null as int), 3), (4, cast(null as int)), (5, 5)) t(a, b)")
both("quantified_array", "select l_orderkey, l_linenumber, exists(array(1, 3, 5), x -> l_linenumber = x) as any_, forall(array(1, 3, 5), x -> l_linenumber >= x) as all_ from lineitem",
     "select l_orderkey, l_linenumber, l_linenumber = any([1, 3, 5]) as any_, l_linenumber >= 5 as all_ from lineitem")
same("row_order_nulls", "select x, row_number() over (order by x desc nulls first) as rn from (values (3), (cast(null as int)), (1), (2)) t(x)")


@query("bind_parameters", "select o_orderkey, o_totalprice from orders where o_custkey = 7 and o_totalprice > 1000")
def bind_parameters(spark, sf_dir):
    parquet(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("select o_orderkey, o_totalprice from orders where o_custkey = ? and o_totalprice > ?", args=[7, 1000])


# Joins

same("join_inner", "select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey where o_totalprice > 100000")
same("join_inner_theta", "select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
same("join_cross", "select r_regionkey, n_nationkey from region cross join nation")
same("join_comma", "select r_name, n_name from region, nation where r_regionkey = n_regionkey")
same("join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey")
same("join_right", "select c_custkey, o_orderkey from orders right join customer on o_custkey = c_custkey and o_totalprice > 50000")
same("join_full", """select a.k as ak, b.k as bk from (select n_nationkey as k from nation where n_nationkey < 15) a
    full join (select n_nationkey as k from nation where n_nationkey > 10) b on a.k = b.k""")
same("join_full_theta", """select a.k as ak, b.k as bk from (select n_nationkey as k from nation where n_nationkey < 5) a
    full join (select n_nationkey as k from nation where n_nationkey < 8) b on a.k + 4 = b.k and b.k <> 6""")
same("join_using", "select k, a, b from (select n_nationkey as k, n_name as a from nation) x join (select s_nationkey as k, s_name as b from supplier) y using (k)")
same("join_self", "select a.o_orderkey as x, b.o_orderkey as y from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey")
same("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
same("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
same("join_null_keys", """select a.k as ak, a.v as av, b.v as bv from (values (1, 'a'), (cast(null as int), 'b'), (1, 'c')) a(k, v)
    join (values (1, 'x'), (cast(null as int), 'y'), (1, 'z')) b(k, v) on a.k = b.k""")
same("join_three_way", """select r_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""")
same("join_top_n", """select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey
    order by o_totalprice desc, o_orderkey limit 20""")
both("join_lateral", """select c_custkey, o_orderkey, o_totalprice from customer, lateral
        (select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2) t""",
     """select c_custkey, o_orderkey, o_totalprice from (select c_custkey, o_orderkey, o_totalprice, row_number() over
        (partition by c_custkey order by o_totalprice desc, o_orderkey) as rn from customer join orders on o_custkey = c_custkey) t where rn <= 2""")


@query("join_natural", "select n_regionkey, n_nationkey, r_name from nation join (select r_regionkey as n_regionkey, r_name from region) r using (n_regionkey)")
def join_natural(spark, sf_dir):
    r = parquet(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return joins.natural_join(parquet(spark, sf_dir, "nation"), r).select("n_regionkey", "n_nationkey", "r_name")


@query("join_range_overlap", """
    with r as (select l_orderkey as k, min(l_linenumber) + l_orderkey * 3 as lo, min(l_linenumber) + l_orderkey * 3 + 5 + count(*) as hi from lineitem group by l_orderkey)
    select a.k as a, b.k as b from r a join r b on a.lo < b.hi and b.lo < a.hi and a.k < b.k""")
def join_range_overlap(spark, sf_dir):
    r = parquet(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.min("l_linenumber") + F.col("l_orderkey") * 3).alias("lo"), (F.min("l_linenumber") + F.col("l_orderkey") * 3 + 5 + F.count(F.lit(1))).alias("hi"))
    a = r.select(F.col("l_orderkey").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = r.select(F.col("l_orderkey").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    return joins.overlap_join(a, b, "alo", "ahi", "blo", "bhi", 8).where("a < b").select("a", "b")


@query("join_array_containment", """
    with s as (select l_orderkey as k, list_sort(list(distinct l_linenumber)) as xs from lineitem group by l_orderkey), c as (select xs, count(*) as n from s group by xs)
    select s.k as a, c.xs as held, c.n from s join c on list_has_all(s.xs, c.xs)""")
def join_array_containment(spark, sf_dir):
    """Over all orders: each with every distinct array that its own holds, and how many orders have that array. An
    order's own array is the longest of its rows, so this stands for all pairs, whose number grows with the square of the orders."""
    s = parquet(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("ax"))
    c = s.groupBy(F.col("ax").alias("bx")).agg(F.count(F.lit(1)).alias("n"))
    return s.join(joins.containment_classes(s, s, "ax", "ax"), "ax").join(c, "bx").select("a", F.col("bx").alias("held"), "n")


# Aggregates

same("agg_count_min_max", "select count(*) as n, count(o_custkey) as k, min(o_orderdate) as lo, max(o_orderpriority) as hi from orders")
both("agg_sum_wide", "select l_linenumber, cast(sum(cast(l_orderkey as decimal(38,0))) as double) as s, sum(cast(l_linenumber as bigint)) as t from lineitem group by l_linenumber",
     "select l_linenumber, cast(sum(cast(l_orderkey as decimal(38,0))) as double) as s, cast(sum(l_linenumber) as bigint) as t from lineitem group by l_linenumber")
both("agg_avg_exact", "select o_custkey, cast(round(avg(cast(o_orderkey as decimal(26,12))), 6) as double) as a from orders group by o_custkey",
     "select o_custkey, round(avg(o_orderkey), 6) as a from orders group by o_custkey")
same("agg_distinct", "select o_custkey, count(distinct o_orderpriority) as p, count(distinct o_orderstatus) as s from orders group by o_custkey")
same("agg_filter", "select o_custkey, count(*) filter (where o_orderstatus = 'F') as f, round(sum(o_totalprice) filter (where o_orderpriority like '1%'), 2) as u from orders group by o_custkey")
same("agg_group_by_expression", "select o_custkey % 10 as b, extract(year from o_orderdate) as y, count(*) as n from orders group by o_custkey % 10, extract(year from o_orderdate)")
same("agg_group_by_ordinal", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
same("agg_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_totalprice) > 100000")
same("agg_empty_input", "select count(*) as n, sum(o_totalprice) as s, min(o_orderkey) as m from orders where o_orderkey < 0")
same("agg_group_null_keys", "select k, count(*) as n from (select case when o_orderkey % 4 = 0 then null else o_orderkey % 3 end as k from orders) t group by k")
same("agg_rollup", "select o_orderstatus as s, o_orderpriority as p, count(*) as n, grouping(o_orderstatus) + 0 as gs, grouping(o_orderpriority) + 0 as gp from orders group by rollup (o_orderstatus, o_orderpriority)")
both("agg_cube", "select o_orderstatus as s, o_orderpriority as p, count(*) as n, grouping_id(o_orderstatus, o_orderpriority) as g from orders group by cube (o_orderstatus, o_orderpriority)",
     "select o_orderstatus as s, o_orderpriority as p, count(*) as n, grouping(o_orderstatus, o_orderpriority) as g from orders group by cube (o_orderstatus, o_orderpriority)")
same("agg_grouping_sets", "select o_orderstatus as s, o_custkey % 5 as c, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_custkey % 5), ())")
same("agg_grouping_sets_window", """select s, n, rank() over (order by n desc) as r from
    (select o_orderstatus as s, count(*) as n from orders group by rollup (o_orderstatus)) t""")
same("agg_distinct_over_aggregates", "select distinct n from (select count(*) as n from orders group by o_custkey) t")


@query("agg_functional_dependency", "select c_custkey, c_name as name, count(o_orderkey) as n from customer join orders on c_custkey = o_custkey group by c_custkey, c_name")
def agg_functional_dependency(spark, sf_dir):
    """GROUP BY the key alone; the other columns of its table hang on it."""
    t = parquet(spark, sf_dir, "customer").join(parquet(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return agg.group_by_key(t, ["c_custkey"], {"name": F.col("c_name")}, F.count("o_orderkey").alias("n"))


@query("agg_mode", "select o_custkey % 50 as k, mode() within group (order by o_orderpriority) as m from (select *, count(*) over (partition by o_custkey % 50, o_orderpriority) as c from orders) t where (o_custkey % 50, c, o_orderpriority) in (select k, c, min(p) from (select o_custkey % 50 as k, o_orderpriority as p, count(*) as c from orders group by 1, 2) u where (k, c) in (select k, max(c) from (select o_custkey % 50 as k, o_orderpriority as p, count(*) as c from orders group by 1, 2) v group by k) group by k, c) group by 1")
def agg_mode(spark, sf_dir):
    return agg.modes(parquet(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), "o_orderpriority"), ["k"], "o_orderpriority", "m")


@query("agg_percentile_cont", "select o_orderstatus, round(percentile_cont(0.25) within group (order by o_totalprice), 4) as q1, round(percentile_cont(0.5) within group (order by o_totalprice), 4) as q2 from orders group by o_orderstatus")
def agg_percentile_cont(spark, sf_dir):
    q = agg.percentiles(parquet(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", {"q1": 0.25, "q2": 0.5})
    return q.select("o_orderstatus", F.round("q1", 4).alias("q1"), F.round("q2", 4).alias("q2"))


@query("agg_percentile_disc_text", "select o_custkey % 20 as k, percentile_disc(0.5) within group (order by o_orderpriority) as p, percentile_disc(0.9) within group (order by o_orderkey) as q from orders group by 1")
def agg_percentile_disc(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 20)
    return agg.percentiles(o, ["k"], "o_orderpriority", {"p": 0.5}, "disc").join(agg.percentiles(o, ["k"], "o_orderkey", {"q": 0.9}, "disc"), "k")


@query("agg_percentile_array", "select o_orderstatus as s, round(quantile_cont(o_totalprice, 0.1), 4) as a, round(quantile_cont(o_totalprice, 0.9), 4) as b from orders group by 1")
def agg_percentile_array(spark, sf_dir):
    q = agg.percentiles(parquet(spark, sf_dir, "orders").withColumn("s", F.col("o_orderstatus")), ["s"], "o_totalprice", {"a": 0.1, "b": 0.9})
    return q.select("s", F.array("a", "b").alias("q")).select("s", F.round(F.col("q")[0], 4).alias("a"), F.round(F.col("q")[1], 4).alias("b"))


@query("agg_percentile_per_group", """select o_custkey % 4 as k, round(case o_custkey % 4 when 0 then quantile_cont(o_totalprice, 0.0) when 1 then quantile_cont(o_totalprice, 0.25)
    when 2 then quantile_cont(o_totalprice, 0.5) else quantile_cont(o_totalprice, 0.75) end, 4) as q from orders group by 1""")
def agg_percentile_per_group(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 4)
    return agg.percentiles(o, ["k"], "o_totalprice", {"q": F.col("k") / 4.0}).select("k", F.round("q", 4).alias("q"))


@query("agg_percentile_interval", "select o_orderstatus as s, cast(round(quantile_cont(epoch(o_orderdate) - epoch(timestamp '1990-01-01'), 0.3) * 1000) as bigint) as ms from orders group by 1")
def agg_percentile_interval(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), (F.col("o_orderdate").cast("timestamp_ntz") - F.lit("1990-01-01").cast("timestamp_ntz")).alias("age"))
    q = agg.percentiles(o, ["s"], "age", {"q": 0.3})
    return q.select("s", F.round(F.unix_micros(F.lit("1970-01-01 00:00:00Z").cast("timestamp") + F.col("q")) / 1000).cast("bigint").alias("ms"))


@query("agg_json_repeated_keys", """select n_regionkey as k, '{' || string_agg('"' || (n_nationkey % 2) || '":"' || n_name || '"', ',' order by n_nationkey) || '}' as o from nation group by 1""")
def agg_json_repeated_keys(spark, sf_dir):
    n = parquet(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").alias("k")).agg(agg.json_object_agg((F.col("n_nationkey") % 2).cast("string"), F.col("n_name"), F.col("n_nationkey")).alias("o"))


@query("agg_hypothetical", """select o_orderstatus as s, 1 + count(*) filter (where o_totalprice < 50000) as r,
    1 + count(distinct case when o_totalprice < 50000 then o_totalprice end) as d, round(count(*) filter (where o_totalprice < 50000) / count(*), 8) as p,
    round((count(*) filter (where o_totalprice <= 50000) + 1) / (count(*) + 1), 8) as c from orders group by 1""")
def agg_hypothetical(spark, sf_dir):
    v, c = F.lit(50000.0), F.col("o_totalprice")
    return parquet(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(agg.rank_of(v, c).alias("r"), agg.dense_rank_of(v, c).alias("d"), F.round(agg.percent_rank_of(v, c), 8).alias("p"), F.round(agg.cume_dist_of(v, c), 8).alias("c"))


_SOME = "(values (1, 2.0), (1, 5.0), (1, null), (2, null), (2, null), (3, 7.0), (3, 7.0)) t(k, x)"


@query("agg_hypothetical_null", f"""select k, 1 + count(x) as r, 1 + count(distinct x) as d, round(count(x) / count(*), 8) as p, 1.0 as c, 1 + count(*) filter (where x < 7.0) as r7,
    round((count(*) filter (where x <= 7.0) + 1) / (count(*) + 1), 8) as c7 from {_SOME} group by k""")
def agg_hypothetical_null(spark, sf_dir):
    t, null, x = spark.sql(f"select k, cast(x as double) as x from {_SOME}"), F.lit(None).cast("double"), F.col("x")
    return t.groupBy("k").agg(agg.rank_of(null, x).alias("r"), agg.dense_rank_of(null, x).alias("d"), F.round(agg.percent_rank_of(null, x), 8).alias("p"), agg.cume_dist_of(null, x).alias("c"), agg.rank_of(F.lit(7.0), x).alias("r7"), F.round(agg.cume_dist_of(F.lit(7.0), x), 8).alias("c7"))


@query("agg_json", "select n_regionkey as k, '[' || string_agg('\"' || n_name || '\"', ',' order by n_name) || ']' as names, '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' order by cast(n_nationkey as varchar)) || '}' as obj from nation group by 1")
def agg_json(spark, sf_dir):
    n = parquet(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").alias("k")).agg(agg.json_agg(F.col("n_name"), strict=True).alias("names"), agg.json_object_agg(F.col("n_nationkey").cast("string"), F.col("n_name"), unique=True).alias("obj"))


# Windows

same("win_ranking", """select o_orderkey, row_number() over w as rn, rank() over v as r, dense_rank() over v as d, round(percent_rank() over v, 8) as p,
    round(cume_dist() over v, 8) as c, ntile(4) over w as t from orders
    window w as (partition by o_custkey order by o_orderdate, o_orderkey), v as (partition by o_custkey order by o_orderpriority)""")
same("win_offset", """select o_orderkey, lag(o_totalprice) over w as a, lead(o_totalprice, 2, 0.0) over w as b, first_value(o_orderkey) over w as f,
    last_value(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as l,
    nth_value(o_orderkey, 2) over w as s from orders window w as (partition by o_custkey order by o_orderkey)""")
same("win_running_sum", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row), 2) as s, count(*) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following) as n from orders")
same("win_range_peers", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderpriority) as n from orders")
same("win_range_null_keys", "select k, v, sum(v) over (order by k nulls last range between 1 preceding and 1 following) + 0 as s from (values (1, 10), (2, 20), (cast(null as int), 30), (cast(null as int), 40), (5, 50)) t(k, v)")
same("win_over_groups", "select o_custkey, count(*) as n, sum(count(*)) over (order by o_custkey) + 0 as running from orders group by o_custkey")
same("win_partition_nulls", "select k, v, count(*) over (partition by k) as n from (values (1, 1), (cast(null as int), 2), (cast(null as int), 3), (1, 4)) t(k, v)")
same("win_top_n_per_group", "select o_custkey, o_orderkey, rn from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) t where rn <= 3")


@query("win_range_frame", "select o_orderkey, count(*) over (order by o_custkey range between 2 preceding and 1 following) as n, sum(o_orderkey) over (partition by o_orderstatus order by o_custkey range between 5 preceding and current row) + 0.0 as s from orders")
def win_range_frame(spark, sf_dir):
    o = windows.range_sum(parquet(spark, sf_dir, "orders"), [], "o_custkey", -2, 1, F.lit(1), "n")
    return windows.range_sum(o, ["o_orderstatus"], "o_custkey", -5, 0, F.col("o_orderkey"), "s").select("o_orderkey", "n", (F.col("s") + F.lit(0.0)).alias("s"))


@query("win_filter", "select o_orderkey, count(*) filter (where o_orderstatus = 'F') over (partition by o_custkey order by o_orderkey) as n, round(sum(o_totalprice) filter (where o_orderstatus = 'O') over (partition by o_custkey), 2) as s from orders")
def win_filter(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    o = parquet(spark, sf_dir, "orders")
    return o.select("o_orderkey", windows.filtered(F.count, F.lit(1), F.col("o_orderstatus") == "F", w.orderBy(asc("o_orderkey"))).alias("n"), F.round(windows.filtered(F.sum, F.col("o_totalprice"), F.col("o_orderstatus") == "O", w), 2).alias("s"))


@query("win_groups_frame", "select o_orderkey, sum(o_orderkey) over (partition by o_custkey order by o_orderpriority groups between 1 preceding and 1 following) + 0.0 as s from orders")
def win_groups(spark, sf_dir):
    o = windows.with_groups(parquet(spark, sf_dir, "orders"), ["o_custkey"], [asc("o_orderpriority")])
    return o.select("o_orderkey", (F.sum("o_orderkey").over(windows.groups_between(["o_custkey"], -1, 1)) + 0.0).alias("s"))


_SPAN = "partition by o_custkey order by o_orderpriority range between unbounded preceding and unbounded following"


@query("win_exclude", f"""select o_orderkey, cast(sum(o_orderkey) over ({_SPAN} exclude current row) as bigint) as a, cast(sum(o_orderkey) over ({_SPAN} exclude group) as bigint) as b,
    cast(sum(o_orderkey) over ({_SPAN} exclude ties) as bigint) as c, count(o_orderkey) over ({_SPAN} exclude group) as d, max(o_orderkey) over ({_SPAN} exclude current row) as e, cast(sum(o_orderkey) over ({_SPAN} exclude no others) as bigint) as f from orders""")
def win_exclude(spark, sf_dir):
    o = windows.numbered(parquet(spark, sf_dir, "orders"), ["o_custkey"], [asc("o_orderpriority")])
    ex = lambda what, fn=F.sum: windows.excluding(F.col("o_orderkey"), what, ["o_custkey"], fn)
    return o.select("o_orderkey", ex("current row").alias("a"), ex("group").alias("b"), ex("ties").alias("c"), ex("group", F.count).alias("d"), ex("current row", F.max).alias("e"), ex("no others").alias("f"))


# Sorting, limits, distinct

same("sort_multi_key_nulls", "select x, y from (values (1, cast(null as int)), (cast(null as int), 2), (1, 3), (0, 4)) t(x, y) order by x desc nulls first, y asc nulls last")
same("sort_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 100")
same("sort_limit_offset", "select o_orderkey from orders order by o_orderkey limit 20 offset 35")
same("sort_by_expression", "select o_orderkey from orders order by o_totalprice / (o_custkey + 1) desc, o_orderkey limit 10")
same("distinct_null_safe", "select distinct k from (select case when o_orderkey % 5 = 0 then null else o_orderkey % 7 end as k from orders) t")


@query("sort_null_largest", "select x from (values (2), (cast(null as int)), (1)) t(x) order by x nulls last limit 2")
def sort_null_largest(spark, sf_dir):
    return spark.sql("select x from values (2), (cast(null as int)), (1) t(x)").orderBy(asc("x")).limit(2)


@query("sort_null_largest_desc", "select x from (values (2), (cast(null as int)), (1)) t(x) order by x desc nulls first limit 2")
def sort_null_largest_desc(spark, sf_dir):
    return spark.sql("select x from values (2), (cast(null as int)), (1) t(x)").orderBy(desc("x")).limit(2)


# Set operations

_A, _B = "select o_custkey as k from orders where o_orderkey % 2 = 0", "select o_custkey as k from orders where o_orderkey % 3 = 0"
for _name, _op in {"union_all": "union all", "union": "union", "intersect": "intersect", "intersect_all": "intersect all", "except": "except", "except_all": "except all"}.items():
    same(f"set_{_name}", f"select k from ({_A} {_op} {_B}) t")
same("set_precedence", "select 1 as k union select 2 intersect select 2 union all select 3 except select 3")
same("set_type_unification", "select cast(x as double) as x from (select 1 as x union all select 2.5 union all select null) t")
same("set_trailing_order", "select n_regionkey as k from nation union select r_regionkey + 10 from region order by k desc limit 6")

# Subqueries

same("sub_scalar", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
same("sub_scalar_correlated", "select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as m from customer")
same("sub_correlated_non_equi", "select n_nationkey, (select count(*) from region where r_regionkey < n_regionkey) as n from nation")
same("sub_exists_in", "select s_suppkey, s_nationkey in (select n_nationkey from nation where n_regionkey = 1) as i from supplier where exists (select 1 from nation where n_nationkey = s_nationkey and n_regionkey <> 3)")
same("sub_not_in_nulls", "select x from (values (1), (2), (cast(null as int))) t(x) where x not in (select y from (values (2), (3)) u(y))")
same("sub_nested_derived", "select avg(n) as a from (select o_custkey, count(*) as n from (select * from orders where o_orderstatus <> 'P') a group by o_custkey) b")


@query("sub_any", "select c_custkey from customer where c_acctbal < any (select s_acctbal from supplier)")
def sub_any(spark, sf_dir):
    return joins.compared(parquet(spark, sf_dir, "customer"), parquet(spark, sf_dir, "supplier"), "c_acctbal", "<", "s_acctbal", "any").select("c_custkey")


@query("sub_all", "select c_custkey from customer where c_acctbal > all (select s_acctbal from supplier)")
def sub_all(spark, sf_dir):
    return joins.compared(parquet(spark, sf_dir, "customer"), parquet(spark, sf_dir, "supplier"), "c_acctbal", ">", "s_acctbal", "all").select("c_custkey")


# Common table expressions and recursion

same("cte_inline", "with t as (select o_custkey, sum(o_totalprice) as s from orders group by o_custkey) select a.o_custkey from t a join t b on a.o_custkey = b.o_custkey where a.s > 200000")
same("cte_nested_shadowing", "with t as (select 1 as x) select x, y from (with t as (select 2 as y) select y from t) u, t")
same("cte_recursive_series", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 50) select n from t")
both("cte_materialized", "with t as (select o_custkey as k, count(*) as n from orders group by o_custkey) select a.k, b.n from t a join t b on a.k = b.k", "with t as materialized (select o_custkey as k, count(*) as n from orders group by o_custkey) select a.k, b.n from t a join t b on a.k = b.k")


@query("cte_recursive_union", "with recursive w(a, b) as (select n_nationkey, (n_nationkey * 3 + 1) % 25 from nation where n_nationkey < 4 union select w.b, (w.b * 3 + 1) % 25 from w) select a, b from w")
def cte_recursive_union(spark, sf_dir):
    start = parquet(spark, sf_dir, "nation").where("n_nationkey < 4").selectExpr("n_nationkey as a", "(n_nationkey * 3 + 1) % 25 as b")
    return recursive.fixpoint(start, lambda w: w.selectExpr("b as a", "(b * 3 + 1) % 25 as b"))
