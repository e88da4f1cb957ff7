"""Comparison of a Spark result with its SQL on DuckDB."""

import datetime
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (pd.Timestamp, datetime.date, datetime.datetime)):
        return str(pd.Timestamp(v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return v


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(repr(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c.sql(sql).df()


def assert_same(df, sql: str, sf_dir: str) -> None:
    got, want = df.toPandas(), oracle(sql, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
