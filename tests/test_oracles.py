"""Every registered query with SQL must give the same rows, values and types."""

import pytest

import __spark_entry__ as contract
from penprint.catalog.compare import connect, differences

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert differences(contract.queries()[name](spark, sf_dir), SQL[name], con) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 20
