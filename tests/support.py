"""Comparing Spark results with DuckDB's by value."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def duck(path: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')").fetchall()
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6))
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return v.date()
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, con, sql: str) -> None:
    """Assert that a DataFrame and a query have the same columns and rows, in any order."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = df.collect()
    assert sorted(df.columns) == sorted(names)
    a, b = rows_of(df.columns, got), rows_of(names, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
