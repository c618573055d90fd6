"""Compares a query's rows with those of its SQL in DuckDB, as bags, floats to nine digits."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(rows):
    return Counter(repr(tuple(plain(v) for v in r)) for r in rows)


def compare(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    got = bag([tuple(r[n] for n in names) for r in df.collect()])
    want = bag([tuple(r[rel.columns.index(n)] for n in names) for r in rel.fetchall()])
    assert got == want
    return sum(got.values())
