"""Comparison of a Spark result with DuckDB's."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        path = f"{DATA}/{sf}/{f}"
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def _value(x):
    if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
        return ""
    if isinstance(x, str):
        return x
    try:
        return str(round(float(x), 9))
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    return sorted(tuple(_value(x) for x in r) for r in df[columns].itertuples(index=False))


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
