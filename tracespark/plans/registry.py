"""All core queries and their SQL, by name."""

from __future__ import annotations

from tracespark.plans import caption_queries, measurement_queries, signal_queries, stream_queries, track_queries

_MODULES = (measurement_queries, track_queries, signal_queries, caption_queries, stream_queries)

QUERIES: dict = {}
SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
