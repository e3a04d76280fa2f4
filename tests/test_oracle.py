"""Every query against its SQL on the smallest data set; the models at least run there."""

import pytest

import __spark_entry__ as entry
from oracle_check import connect, difference

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
