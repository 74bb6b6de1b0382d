"""Spark queries against their SQL twins on one folder of tables."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    clean = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)
