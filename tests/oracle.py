"""Comparison of a query with its SQL, as sets of rows with columns in order of name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v) if not isinstance(v, str) else v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(_plain(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


def compare(con: duckdb.DuckDBPyConnection, pdf: pd.DataFrame, sql: str) -> str:
    """What differs, or nothing."""
    want = con.execute(sql).df()
    if sorted(pdf.columns) != sorted(want.columns):
        return f"columns {sorted(pdf.columns)} and {sorted(want.columns)}"
    a, b = rows(pdf), rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}; {[x for x in a if x not in set(b)][:3]} {[x for x in b if x not in set(a)][:3]}"
    return "" if a == b else str([(x, y) for x, y in zip(a, b) if x != y][:3])
