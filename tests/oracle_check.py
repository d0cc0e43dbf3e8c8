"""Compares a query with its DuckDB SQL, types of columns included."""

import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), names)
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    assert got == want, (sum(got.values()), sum(want.values()), list((got - want).items())[:3], list((want - got).items())[:3])
    kinds = {n: t for n, t in df.dtypes}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    theirs = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    assert {n: same.get(k, k) for n, k in kinds.items()} == theirs
    return sum(want.values())
