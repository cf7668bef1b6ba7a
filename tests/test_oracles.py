"""Every query with a SQL counterpart gives its rows, at the smallest scale."""

import pytest
from side_by_side import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, sf, name):
    assert compare(spark, con, queries()[name], ORACLES[name], sf) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 15 and "max_velocity_24h" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())
