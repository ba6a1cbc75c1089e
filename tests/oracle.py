"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v) -> str:
    if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(frame) -> list[tuple[str, ...]]:
    names = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


def same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
