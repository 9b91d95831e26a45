"""Rows of a query and of its SQL, in a form that can be compared."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}")
    return str(v)


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def assert_same(df, conn, sql):
    r = conn.execute(sql)
    columns = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of(columns, r.fetchall())
