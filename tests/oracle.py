"""Comparison of a query's rows with its SQL's on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
    return sorted([tuple(text(r[i]) for i in order) for r in data])


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())
