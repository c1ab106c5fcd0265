"""Every core query against its SQL on the smallest tables; those without SQL must run and keep a schema."""

import pytest
from conftest import SMALL
from oracle import compare

from tracespark.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
