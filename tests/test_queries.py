"""Every query of the engine against its SQL, on whole tables."""

from __future__ import annotations

import pytest

from conftest import SF_DIR, spark_rows, sql_rows
from kinelex.plans import all as plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_gives_the_same_rows_twice(spark, name):
    rows = spark_rows(QUERIES[name](spark, SF_DIR))
    assert rows[1] and rows == spark_rows(QUERIES[name](spark, SF_DIR))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
