"""All queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tracespark.llm import split_queries, text_queries

_MODULES = (split_queries, text_queries)

QUERIES: dict = {}
SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
