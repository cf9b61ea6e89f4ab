"""Holds registered queries against their SQL, run by DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def assert_same(spark, query, sql: str, sf: str) -> None:
    df = query(spark, sf)
    cols = sorted(df.columns)
    r = connect(sf).sql(sql)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    assert got == want
