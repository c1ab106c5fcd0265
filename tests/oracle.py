"""Compares a query with its SQL, as sets of rows with multiplicity."""

from __future__ import annotations

import decimal
import math
import os


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, query, sql: str, folder: str) -> None:
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    df = query(spark, folder)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert len(have) == len(want)
    assert have == want
