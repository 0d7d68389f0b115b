"""Comparison of a Spark plan with its DuckDB twin, by sorted rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def views(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def _text(x: object) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    return str(int(x)) if hasattr(x, "__index__") else str(x)


def canonical(rows: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(rows.columns)
    return rows[columns].apply(lambda c: c.map(_text)).sort_values(columns).reset_index(drop=True)
