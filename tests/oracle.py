"""Runs a query and its SQL on the same tables and compares rows whatever their order."""

from __future__ import annotations

import math
import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(normal, v))
    return v if isinstance(v, int | bool | type(None)) else str(v)


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(normal(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
