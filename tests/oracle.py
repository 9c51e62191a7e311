"""Runs a query on Spark and its SQL on DuckDB, and compares all rows."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(df, con, sql):
    want = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    expected = sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall())
    got = sorted("|".join(plain(r[c]) for c in names) for r in df.collect())
    assert got == expected
