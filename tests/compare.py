"""Rows of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np

SMALL = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, np.floating)):
        return round(float(x), 6)
    return x if isinstance(x, (int, str)) else str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def oracle(sql: str, sf_dir: str = SMALL):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    found = [x[0] for x in cursor.description]
    order = sorted(range(len(found)), key=lambda i: found[i])
    return sorted(found), sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
