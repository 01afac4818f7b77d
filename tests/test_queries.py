"""Every named query of the library against its SQL."""

import pytest
from compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries
from creditgrain.plans.oracle import ORACLE

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, connection, name):
    assert differences(queries()[name](spark, DATA), connection.sql(oracle_sql()[name])) == []


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert len(df.columns) == 28 and df.count() == 150
