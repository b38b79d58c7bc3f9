"""Compare a Spark query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(_norm(v) for v in value)
    return str(value) if value is not None and not isinstance(value, int | bool) else value


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    assert sorted(df.columns) == sorted(names)
    have = rows(df.columns, df.collect())
    assert len(have) == len(want), (len(have), len(want))
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    assert not bad, bad[:3]
