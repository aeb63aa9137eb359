"""Statements as text through Engine.execute()."""

import pytest

from lodestra.plans import statements as st
from lodestra.plans.session import Engine


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.execute("create table t (k int, v string, n int)")
    e.execute("insert into t values (1, 'one', 10), (2, 'it''s, two', 20), (null, 'none', 30);")
    yield e
    e.execute("drop table t")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_insert_and_conflicts(engine):
    x = engine.execute
    assert rows(x("insert into t (k, n) values (1, 5), (3, 6), (3, 7) on conflict (k) do nothing returning k, n * 2 as d")) == [(3, 12)]
    assert rows(x("insert into t (k, v, n) values (1, 'uno', 1), (4, 'four', 4) on conflict (k) do update set v = excluded.v, n = t.n + excluded.n where t.n > 5 returning *")) == [(1, "uno", 11), (4, "four", 4)]
    with pytest.raises(Exception, match="21000"):
        x("insert into t values (1, 'a', 1), (1, 'b', 1) on conflict (k) do update set v = excluded.v")
    x("insert into t select k + 100, v, n from t where k is not null")
    assert rows(x("select k, n from t where k is not null and k <> 2 order by k")) == sorted([(1, 11), (3, 6), (4, 4), (101, 11), (102, 20), (103, 6), (104, 4)], key=str)


def test_update_and_delete(engine):
    x = engine.execute
    assert rows(x("update t set n = n + 1, v = upper(v) where k = $1 returning k, old_n, n", [2])) == [(2, 20, 21)]
    assert rows(x("delete from t where k is null returning v")) == [("none",)]
    assert rows(x("select v from t")) == [("IT'S, TWO",), ("one",)]
    assert x("delete from t").count() == 0 and x("select * from t").count() == 0


def test_query_operators_and_parameters(engine):
    x = engine.execute
    assert rows(x("select k from t where v ~ '^o' or v ~* 'TWO$'")) == [(1,), (2,)]
    assert rows(x("select v from t where v !~ 'o'")) == []
    assert rows(x("select k from t where k = any (array[2, 3]) -- a comment")) == [(2,)]
    assert rows(x("select k from t where (k + 1) = any (array[$1, 9])", [2])) == [(1,)]
    assert rows(x("select k from t where k = any (select 1)")) == [(1,)]
    assert rows(x("select $2 || v from t where n = $1", [10, "~ $1 "])) == [("~ $1 one",)]


def test_create_drop_and_errors(engine):
    x = engine.execute
    x("create temp table u as select k * 2 as d from t where k is not null")
    assert rows(x("select d from u")) == [(2,), (4,)]
    with pytest.raises(ValueError, match="42P07"):
        x("create table u (a int)")
    x("drop table u")
    with pytest.raises(ValueError, match="42P01"):
        x("drop table u")
    x("drop table if exists u")
    with pytest.raises(ValueError, match="42P01"):
        x("insert into u values (1)")


def test_clauses_stay_inside_brackets_and_quotes():
    c = st.clauses(st.tokens("update t set a = (select 1 where true), b = 'x where y' where k in (1, 2) returning a"), "update", "set", "where", "returning")
    assert c == {"": "", "update": "t", "set": "a = (select 1 where true), b = 'x where y'", "where": "k in (1, 2)", "returning": "a"}
    assert st.assignments("a = f(1, 2), b = c = 3") == {"a": "f(1, 2)", "b": "c = 3"}


def test_json_operators_and_functions_by_name(engine):
    x = engine.execute
    x("""create table d as select 1 as k, '{"a": {"b": [1, 2, {"c": "x"}]}, "n": null, "it''s": "t"}' as j union all select 2, '{"a": 5}' union all select 3, null""")
    one = lambda text: rows(x(f"select {text} as v from d where k = 1"))[0][0]
    assert one("j -> 'a' -> 'b' ->> 1") == "2" and one("j #>> '{a,b,2,c}'") == "x" and one("j #> '{a,b}'") == '[1,2,{"c":"x"}]'
    assert one("j ? 'n'") is True and one("j ? 'zz'") is False and one("j ?| array['zz', 'a']") is True and one("j ?& array['zz', 'a']") is False
    assert rows(x("select k from d where j -> 'a' = '5' or j ->> 'it''s' = 't'")) == [(1,), (2,)]
    assert rows(x("""select k from d where j @> '{"a": 5}'""")) == [(2,)] and rows(x("""select k from d where '{"a": 5.0}' <@ j and j @? '$.a'""")) == [(2,)]
    assert one("jsonb_typeof(j -> 'a')") == "object" and one("jsonb_array_length(j #> '{a,b}')") == 3
    assert one("jsonb_set('[1, 2]', '{1}', '7')") == "[1, 7]" and one("""jsonb_path_query_array(j, '$.a.b[*] ? (@ > 1)')""") == "[2]"
    assert rows(x("select k, e from d lateral view explode(jsonb_path_query(j, '$.a.b[0 to 1]')) t as e")) == [(1, "1"), (1, "2")]
    assert one("quote_literal('it''s')") == "'it''s'" and one("quote_ident('A b')") == '"A b"' and one("to_hex(255)") == "ff" and one("strpos('abc', 'c')") == 3
    assert one("transform(array(1, 2), y -> 1)") == [1, 1] and one("array[1, 2, 3] @> array[2, 1]") is True and one("array[1] && array[2]") is False
    with pytest.raises(ValueError, match="0A000"):
        x("select j -> k from d")
    x("drop table d")
