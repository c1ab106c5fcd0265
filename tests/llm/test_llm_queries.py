"""Queries of the subpackage against their SQL, or as a run, on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import compare

from tracespark.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", ["p1_found", "p1_split_report", "p2_found", "p4_pieces", "p7_token_counts", "p8_fill_report", "p9_found"])
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() > 0
