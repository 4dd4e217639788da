"""Row-by-row comparison of a Spark query with DuckDB on the same tables."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    return tuple(map(cell, x)) if isinstance(x, list) else x


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [x[0] for x in cur.description], cur.fetchall()


def assert_same(df, sf_dir, sql):
    names, rows = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = Counter(tuple(cell(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    want = Counter(tuple(cell(r[i]) for i in at) for r in rows)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
