"""Runs a query and its SQL over the same tables and compares names and values, in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    found = con.sql(sql)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    assert sorted(found.columns) == names
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
