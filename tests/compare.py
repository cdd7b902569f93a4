"""Run a query in Spark and its SQL in DuckDB over the same files and compare the rows."""

import glob
import os
from collections import Counter

import duckdb


def connect(d):
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    return round(v, 6) if isinstance(v, float) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return Counter(tuple(norm(r[c]) for c in cols) for r in df.collect()), cols


def oracle_rows(con, sql):
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall()), sorted(names)
