"""Run a query and its SQL over the same tables, and compare rows whatever their order."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Asserts equal columns and rows; gives their number."""
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    want = rows_of(columns, got.fetchall())
    assert sorted(df.columns) == sorted(columns)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert have == want
    return len(have)
