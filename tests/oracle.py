"""Runs a query and its DuckDB twin and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql, sf=SF):
    names, rows = duck(sql, sf)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(names, rows)
