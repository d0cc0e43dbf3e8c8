"""Compares a query with its DuckDB SQL."""

import os
from collections import Counter

import duckdb


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = os.path.join(sf_dir, f)
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), names)
    assert sorted(names) == sorted(df.columns)
    assert sum(got.values()) == sum(want.values())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
