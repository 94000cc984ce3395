"""Compare registered queries with their DuckDB statements."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def same(frame, relation):
    cols = sorted(frame.columns)
    assert cols == sorted(relation.columns)
    at = [relation.columns.index(c) for c in cols]
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in frame.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert ours == theirs
