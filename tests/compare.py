"""Order-insensitive comparison of a Spark result with what DuckDB says."""

import os

import duckdb
import pandas as pd


def views(d):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        numeric = pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])
        df[c] = df[c].astype(float).round(9) + 0.0 if numeric else df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = canonical(got), canonical(want)
    same = (a.values == b.values) | (pd.isna(a.values) & pd.isna(b.values))
    assert same.all(), (a[~same.all(axis=1)].head(3), b[~same.all(axis=1)].head(3))
