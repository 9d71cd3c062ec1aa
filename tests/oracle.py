"""Spark rows against DuckDB rows of a query."""

import os
from collections import Counter

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


def compare(spark, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = connection(folder).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert mine == theirs
