"""Tables made by statements: their rules, actions of foreign keys, identities, ALTER TABLE and transactions."""

import pytest

from lodestra.plans import definitions as de
from lodestra.plans.session import Engine


@pytest.fixture
def x(spark):
    e = Engine(spark)
    yield e.execute
    e.execute("rollback")
    if e.tables:
        e.execute("drop table " + ", ".join(e.tables))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fails(x, code, *texts):
    for text in texts:
        with pytest.raises(Exception, match=rf"\[{code}\]"):
            x(text)


def test_rules_hold(x):
    x("create table t (id i32 primary key, v text default upper('a') || 'b' not null, n i64 check (n > 0) unique, constraint small check (id < 100 and n < 50))")
    x("insert into t (id, n) values (1, 10), (2, null)")
    assert rows(x("select * from t")) == [(1, "Ab", 10), (2, "Ab", None)]
    fails(x, "23505", "insert into t (id) values (1)", "insert into t (id) values (7), (7)", "update t set n = 10", "insert into t (id, n) values (3, 10)")
    fails(x, "23502", "insert into t values (3, null, 1)", "insert into t (v) values ('x')", "update t set id = null where id = 1")
    fails(x, "23514", "insert into t (id, n) values (3, 0)", "insert into t (id, n) values (100, 1)", "update t set n = 50 where id = 1")
    assert rows(x("insert into t values (3, default, default) returning *")) == [(3, "Ab", None)]
    assert rows(x("update t set v = default, n = default where id = 1 returning v, n")) == [("Ab", None)]
    fails(x, "42601", "insert into t values (4, 'a', 1, 1)")
    fails(x, "42703", "insert into t (q) values (4)", "create table u (a int, unique (b))")
    fails(x, "42P16", "create table u (a int primary key, b int primary key)")
    fails(x, "42701", "create table u (a int, a text)")
    assert x("select * from t").count() == 3


def test_foreign_keys_and_their_actions(x):
    x("create table p (id int primary key)")
    x("create table c (id int primary key, pid int references p on update cascade on delete cascade)")
    x("create table g (id int primary key, cid int references c on delete cascade)")
    x("create table n (a int default 2 references p on delete set default on update set null, b int)")
    x("create table r (pid int references p (id))")
    x("insert into p values (1), (2), (3)")
    x("insert into c values (10, 1), (20, 1), (30, 2), (40, null)")
    x("insert into g values (100, 10), (300, 30)")
    x("insert into n values (1, 7), (3, 8)")
    fails(x, "23503", "insert into c values (50, 9)", "update c set pid = 9 where id = 10")
    assert rows(x("update p set id = 11 where id = 1 returning id")) == [(11,)]
    assert rows(x("select * from c")) == sorted([(10, 11), (20, 11), (30, 2), (40, None)], key=str)
    x("delete from p where id in (3, 11)")
    assert rows(x("select * from c")) == sorted([(30, 2), (40, None)], key=str)
    assert rows(x("select * from g")) == [(300, 30)]
    assert rows(x("select * from n")) == sorted([(None, 7), (2, 8)], key=str)
    x("insert into r values (2)")
    fails(x, "23503", "delete from p", "update p set id = 5")
    assert rows(x("select * from p")) == [(2,)] and x("select * from c").count() == 2
    fails(x, "2BP01", "drop table p")
    fails(x, "42830", "create table z (a int references g (cid))")
    fails(x, "42804", "create table z (a text references p)")
    fails(x, "42P01", "create table z (a int references nowhere)")
    x("drop table p cascade")
    x("insert into r values (99)")


def test_cascade_along_a_table_that_refers_to_itself(x):
    x("create table tree (id int primary key, up int references tree on delete cascade)")
    x("insert into tree values (1, null), (2, 1), (3, 2), (4, 3), (5, null), (6, 5)")
    x("delete from tree where id = 2")
    assert rows(x("select id from tree")) == [(1,), (5,), (6,)]


def test_composite_keys(x):
    x("create table p (a int, b text, primary key (a, b))")
    x("create table c (id int, x int, y text, foreign key (x, y) references p on update set null on delete set null)")
    x("insert into p values (1, 'q'), (2, 'q')")
    x("insert into c values (10, 1, 'q'), (20, 2, 'q'), (30, 9, null)")
    x("update p set a = 3 where a = 1")
    x("delete from p where a = 2")
    assert rows(x("select * from c")) == [(10, None, None), (20, None, None), (30, 9, None)]


def test_identities_and_serials(x):
    x("create table a (id int generated always as identity primary key, v text)")
    x("insert into a (v) values ('x'), ('y')")
    x("insert into a (id, v) values (default, 'z')")
    fails(x, "428C9", "insert into a (id, v) values (9, 'no')", "update a set id = 9")
    x("insert into a (id, v) overriding system value values (100, 's')")
    x("insert into a (id, v) overriding user value select 77, 'u'")
    assert rows(x("select * from a")) == sorted([(1, "x"), (2, "y"), (3, "z"), (100, "s"), (4, "u")], key=str)
    x("create table b (v text, id bigint generated by default as identity (start with 10 increment by 5), s serial)")
    x("insert into b (v) values ('x'), ('y')")
    x("insert into b values ('z', 1, 1)")
    assert rows(x("select v, id, s from b")) == [("x", 10, 1), ("y", 15, 2), ("z", 1, 1)]
    fails(x, "42601", "create table z (a int default 1 generated always as identity)")
    fails(x, "22023", "create table z (a text generated always as identity)")


def test_alter_table(x):
    x("create table t (id i32 primary key)")
    x("create table k (t_id int references t)")
    x("insert into t values (1), (2)")
    x("alter table t add column amount i32 default 1 + 1 not null, add note text")
    assert rows(x("select * from t")) == [(1, 2, None), (2, 2, None)]
    fails(x, "23502", "alter table t add required int not null")
    fails(x, "23514", "alter table t add bad int default 1, add check (bad > 5)")
    fails(x, "42703", "alter table t drop bad", "alter table t rename bad to good")
    fails(x, "42701", "alter table t add amount text", "alter table t rename id to note")
    x("alter table t add column if not exists amount text, add constraint low check (amount < 10)")
    x("alter table t rename column amount to price")
    fails(x, "23514", "update t set price = 10")
    x("alter table t rename constraint low to lower, alter price type bigint using price * 4")
    assert rows(x("select price from t")) == [(8,), (8,)]
    x("alter table t drop constraint lower, alter column price set default 99")
    fails(x, "23502", "alter table t alter note set not null")
    fails(x, "2BP01", "alter table t drop column id")
    x("alter table t rename id to key")
    x("alter table t rename to s")
    x("insert into s (key) values (3)")
    x("insert into k values (3)")
    fails(x, "23503", "insert into k values (4)", "delete from s where key = 3")
    x("alter table s drop column key cascade, drop column if exists nothing")
    assert rows(x("select * from s")) == sorted([(8, None), (8, None), (99, None)], key=str)
    x("insert into k values (4)")
    fails(x, "42704", "alter table s drop constraint nothing")
    x("alter table if exists nowhere add a int")


def test_transactions(x):
    x("create table t (id int primary key, s serial)")
    x("insert into t (id) values (1)")
    x("begin")
    x("insert into t (id) values (2)")
    x("create table u (a int)")
    x("update t set id = 10 where id = 1")
    x("rollback")
    assert rows(x("select * from t")) == [(1, 1)]
    fails(x, "42P01", "insert into u values (1)")
    x("start transaction")
    fails(x, "25001", "begin")
    x("insert into t (id) values (2)")
    x("commit work")
    assert rows(x("select * from t")) == [(1, 1), (2, 2)]
    x("begin")
    x("drop table t")
    fails(x, "42P01", "insert into t (id) values (3)")
    fails(x, "25P02", "select 1", "insert into t (id) values (3)")
    x("commit")  # of a failed transaction: nothing stays
    assert rows(x("select * from t")) == [(1, 1), (2, 2)]
    x("begin read only")
    fails(x, "25006", "delete from t")
    x("rollback")
    x("begin read only")
    assert x("select * from t").count() == 2
    x("end")
    x("commit")
    x("delete from t where id = 1")


def test_privileges_of_statements(spark):
    e = Engine(spark)
    e.execute("create table t (a int)")
    e.grant("insert", "t")
    e.execute("insert into t values (1)")
    for text in ("update t set a = 2", "delete from t", "select * from t"):
        with pytest.raises(PermissionError, match="42501"):
            e.execute(text)
    e.grant("delete", "T")
    e.execute("delete from t")
    e.revoke("insert", "t")
    with pytest.raises(PermissionError, match="42501"):
        e.execute("insert into t values (1)")
    e.execute("drop table t")


def test_items_of_a_column_list():
    d = de.Definition()
    d.add("t", "a numeric(10, 2) default round(1.5, 1) + (2 * 3) not null check (a in (1, 2) or a > 5)")
    assert d.columns == {"a": "decimal(10, 2)"} and d.defaults == {"a": "round(1.5, 1) + (2 * 3)"}
    assert [(r.kind, r.columns, r.name) for r in d.rules] == [("required", ("a",), ""), ("check", ("a",), "t_a_check")]
    assert d.rules[1].text == "a in (1, 2) or a > 5"
    with pytest.raises(ValueError, match="42601"):
        d.add("t", "b int primary")
