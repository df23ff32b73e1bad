"""Every query with SQL gives the same rows; the others give stable rows."""

import pytest

import __spark_entry__ as entry_module
from oracle.compare import compare, connect

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, connection):
    assert compare(QUERIES[name](spark, sf_dir), connection, SQL[name]) == []


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert "in_range_percent" in df.columns


def test_the_sql_takes_nothing_from_the_library():
    import oracle.sql

    with open(oracle.sql.__file__) as file:
        assert "glycospan" not in file.read()
