"""Every query with SQL gives its rows; the others run and have stable columns."""

from __future__ import annotations

import pytest

from tests.oracle import SF, assert_same, connect
from tidemark import catalog

QUERIES, SQL = catalog.load()
#: Long ones without SQL; those of them that have value tests of the operator are in test_operators and test_learners.
SLOW = ("M", "C10", "G8", "X9_forecast", "X4_learners")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), connect().sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL and not k.startswith(SLOW)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.limit(200).toPandas()
    assert len(set(df.columns)) == len(df.columns) and len(rows) and rows.notna().any().any()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
