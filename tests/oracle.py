"""Runs a query's SQL twin in DuckDB and compares rows regardless of order."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


def same(df, con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    want = sorted(repr([plain(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == want
