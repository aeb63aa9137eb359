"""Every registered relational query against its DuckDB twin."""

import pytest

from lodestra import queries, registry  # noqa: F401
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, con, small, name):
    assert compare(spark, con, small, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
