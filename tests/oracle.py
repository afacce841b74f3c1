"""Spark queries against DuckDB, as multisets of rows with columns by name."""

import math
import os

import duckdb

DATA = os.environ.get("SKERRY_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return repr(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return rows_of(names, cursor.fetchall()), [str(d[1]) for d in cursor.description], names


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
