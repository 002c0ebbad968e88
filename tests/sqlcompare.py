"""Holds a query's rows against those of its SQL in DuckDB over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF_DIR)


def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return repr(round(v, 7) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    got = df.collect()
    res = con.execute(sql)
    names, want = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert _plain(map(tuple, got), df.columns) == _plain(want, names)
