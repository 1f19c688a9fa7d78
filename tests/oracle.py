"""Side-by-side comparison of a query with its SQL."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, fn, sql, sf):
    df = fn(spark, sf)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf).sql(sql)
    theirs = rows(list(rel.columns), rel.fetchall())
    assert ours == theirs
    return ours[1]
