"""Rows of a Spark query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import glob

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return con


def value(v):
    if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "__float__") and not hasattr(v, "year"):
        return f"{float(v) + 0.0:.5f}"
    return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "year") else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))
