"""Every registered query against its DuckDB statement."""

import pytest
from compare import differences, duck, oracle_rows

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    return duck(SF), entry.oracle_sql()


NAMES = [query.__name__ for query in entry.QUERIES]


def test_statements_and_queries_pair_up():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    connection, statements = oracle
    df = entry.queries()[name](spark, SF)
    assert differences(df, *oracle_rows(connection, statements[name])) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
