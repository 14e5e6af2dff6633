"""Rows of Spark and DuckDB as comparable values."""

import os

import duckdb
import pandas as pd

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted([tuple(map(value, r)) for r in frame.astype(object).values.tolist()], key=repr)
