"""Rows of Spark and DuckDB results in a form that compares."""

from __future__ import annotations

import glob
import os

import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.execute(sql).df()


def rows(d: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.integer, np.floating)):
            return round(float(v), 6) + 0.0
        return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)

    d = d[sorted(d.columns)]
    return sorted((tuple(plain(v) for v in t) for t in d.itertuples(index=False)), key=str)
