"""Statements as text through Engine.execute(), over whole tables, with their DuckDB twins."""

from __future__ import annotations

import re

from lodestra.plans.session import Engine
from lodestra.registry import query
from lodestra.sources.readers import TABLES, parquet


def _engine(spark, sf_dir: str, texts: list[str]) -> Engine:
    """A session that sees the tables which the statements name."""
    e = Engine(spark)
    for name in set(re.findall(r"[a-z_]+", " ".join(texts))) & set(TABLES):
        parquet(e.spark, sf_dir, name).createOrReplaceTempView(name)
    return e


def statements(name: str, *texts: str, oracle: str, args: list | None = None) -> None:
    """A query that runs the texts in one session; the rows are the last one's, which args belong to."""

    def run(spark, sf_dir):
        e = _engine(spark, sf_dir, list(texts))
        for text in texts[:-1]:
            e.execute(text)
        return e.execute(texts[-1], args)

    query(name, oracle)(run)


_ORDERS = "create table o as select o_orderkey as k, o_custkey as c, o_totalprice as p, o_orderstatus as s from orders"
_JSON = """(select o_orderkey as k, concat('{"c": ', o_custkey, ', "s": {"v": "', o_orderstatus, '", "l": [', o_orderkey % 3, ', ', o_custkey % 4, ']}}') as j from orders)"""

statements("st_parameters", "select o_orderkey as k from orders where o_totalprice > $1 and o_orderstatus = $2", args=[100000.0, "F"], oracle="select o_orderkey as k from orders where o_totalprice > 100000 and o_orderstatus = 'F'")
statements("st_regex_operators", "select p_partkey as k, p_name ~ '[aeiou]{2}' as a, p_name ~* '^[A-M]' as b, p_name !~ 'a' as c from part", oracle="select p_partkey as k, regexp_matches(p_name, '[aeiou]{2}') as a, regexp_matches(p_name, '^[A-M]', 'i') as b, not regexp_matches(p_name, 'a') as c from part")
statements("st_any_array", "select l_orderkey as k, l_linenumber as l from lineitem where l_linenumber = any (array[2, $1])", args=[5], oracle="select l_orderkey as k, l_linenumber as l from lineitem where l_linenumber in (2, 5)")
statements("st_json_members", f"select k, j ->> 'c' as c, j -> 's' ->> 'v' as v, j #>> '{{s,l,1}}' as l, j #> '{{s,l}}' as a from {_JSON} t", oracle="select o_orderkey as k, cast(o_custkey as varchar) as c, o_orderstatus as v, cast(o_custkey % 4 as varchar) as l, '[' || o_orderkey % 3 || ',' || o_custkey % 4 || ']' as a from orders")
statements("st_json_keys", f"select k, j ? 's' as a, j -> 's' ? 'c' as b, j ?| array['x', 'c'] as c, j ?& array['x', 'c'] as d from {_JSON} t", oracle="select o_orderkey as k, true as a, false as b, true as c, false as d from orders")
statements("st_json_containment", f"""select k, j @> '{{"s": {{"l": [2]}}}}' as a, '{{"c": 1}}' <@ j as b, j @? '$.s.l[*] ? (@ == 3)' as c from {_JSON} t""", oracle="select o_orderkey as k, o_orderkey % 3 = 2 or o_custkey % 4 = 2 as a, o_custkey = 1 as b, o_custkey % 4 = 3 as c from orders")
statements("st_json_functions", f"select k, jsonb_typeof(j -> 's') as t, jsonb_array_length(j #> '{{s,l}}') as n, jsonb_path_query_array(j, '$.s.l[*] ? (@ > 0)') as q from {_JSON} t", oracle="select o_orderkey as k, 'object' as t, 2 as n, '[' || concat_ws(', ', case when o_orderkey % 3 > 0 then o_orderkey % 3 end, case when o_custkey % 4 > 0 then o_custkey % 4 end) || ']' as q from orders")
statements("st_array_operators", "select l_orderkey as k, l_linenumber as l, array[l_linenumber, l_suppkey] @> array[1] as a, array[l_linenumber] && array[2, 3] as b from lineitem", oracle="select l_orderkey as k, l_linenumber as l, l_linenumber = 1 or l_suppkey = 1 as a, l_linenumber in (2, 3) as b from lineitem")
statements("st_insert_returning", _ORDERS, "insert into o (k, p) select o_orderkey * -1, 1 from orders where o_orderstatus = 'F' returning k, p * 2 as d, c", oracle="select -o_orderkey as k, 2.0 as d, null as c from orders where o_orderstatus = 'F'")
statements("st_insert_conflict", _ORDERS, "insert into o (k, c, p) select o_orderkey + 2, 5, 9 from orders on conflict (k) do update set c = o.c + excluded.c, p = excluded.p where o.s <> 'F'", "select k, c, p, s from o", oracle="with n as (select o_orderkey + 2 as k from orders) select o_orderkey as k, case when n.k is not null and o_orderstatus <> 'F' then o_custkey + 5 else o_custkey end as c, case when n.k is not null and o_orderstatus <> 'F' then 9 else o_totalprice end as p, o_orderstatus as s from orders left join n on n.k = o_orderkey union all select k, 5, 9, null from n where k not in (select o_orderkey from orders)")
statements("st_update", _ORDERS, "update o set p = p * 2, s = lower(s) where c % 2 = 0", "select k, c, p, s from o", oracle="select o_orderkey as k, o_custkey as c, case when o_custkey % 2 = 0 then o_totalprice * 2 else o_totalprice end as p, case when o_custkey % 2 = 0 then lower(o_orderstatus) else o_orderstatus end as s from orders")
statements("st_delete_returning", _ORDERS, "delete from o where s = 'F' and p > 50000 returning k, p", oracle="select o_orderkey as k, o_totalprice as p from orders where o_orderstatus = 'F' and o_totalprice > 50000")
_PARENT = "create table c (k bigint primary key)"
_CHILD = "create table o (k bigint primary key, c bigint references c on delete {} on update cascade, p double check (p > -1))"
_FILL = ["insert into c select c_custkey from customer", "insert into o select o_orderkey, o_custkey, o_totalprice from orders where o_custkey in (select c_custkey from customer)"]
_HELD = "orders where o_custkey in (select c_custkey from customer)"
statements("ddl_delete_cascade", _PARENT, _CHILD.format("cascade"), *_FILL, "delete from c where k % 3 = 0", "select k, c, p from o", oracle=f"select o_orderkey as k, o_custkey as c, o_totalprice as p from {_HELD} and o_custkey % 3 <> 0")
statements("ddl_delete_set_null", _PARENT, _CHILD.format("set null"), *_FILL, "delete from c where k % 3 = 0", "select k, c, p from o", oracle=f"select o_orderkey as k, case when o_custkey % 3 <> 0 then o_custkey end as c, o_totalprice as p from {_HELD}")
statements("ddl_update_cascade", _PARENT, _CHILD.format("cascade"), *_FILL, "update c set k = -k where k % 2 = 1", "select k, c, p from o", oracle=f"select o_orderkey as k, case when o_custkey % 2 = 1 then -o_custkey else o_custkey end as c, o_totalprice as p from {_HELD}")
statements("ddl_identity_default", "create table t (id bigint generated always as identity (start with 10 increment by 2), k bigint, s text default upper('new'))", "insert into t (k) select n_nationkey from nation order by n_nationkey", "select id, k, s from t", oracle="select 10 + 2 * (row_number() over (order by n_nationkey) - 1) as id, n_nationkey as k, 'NEW' as s from nation")
statements("ddl_alter_table", _ORDERS, "alter table o add column n i32 default 1 + 1 not null, drop column s, add check (n = 2)", "alter table o rename column p to price", "select k, c, price, n from o", oracle="select o_orderkey as k, o_custkey as c, o_totalprice as price, 2 as n from orders")
statements("tx_rollback", _ORDERS, "begin", "delete from o where s = 'F'", "update o set p = 0", "rollback", "select k, c, p, s from o", oracle="select o_orderkey as k, o_custkey as c, o_totalprice as p, o_orderstatus as s from orders")
statements("tx_commit", _ORDERS, "begin", "delete from o where s = 'F'", "commit", "rollback", "select k, c, p, s from o", oracle="select o_orderkey as k, o_custkey as c, o_totalprice as p, o_orderstatus as s from orders where o_orderstatus <> 'F'")
