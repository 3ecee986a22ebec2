"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f + '/*.parquet' if os.path.isdir(f) else f}')")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5)
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def assert_same(got, want) -> None:
    got, want = tidy(got), tidy(want)
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype.kind in "fiub" and b.dtype.kind in "fiub":
            assert np.isclose(a.astype(float), b.astype(float), rtol=1e-7, atol=2e-5, equal_nan=True).all(), c
        else:
            blank = {"None": "nan", "NaT": "nan", "<NA>": "nan"}
            assert (a.astype(str).replace(blank) == b.astype(str).replace(blank)).all(), c
