"""Compares a registered query with its SQL on the given tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (pd.Timestamp,)) or hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v.item() if hasattr(v, "item") else v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


def assert_same(spark_df, sql: str, con) -> None:
    got, want = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(x == y or all(p == q or (isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) <= 2e-6 * max(1, abs(q))) for p, q in zip(x, y)) for x, y in zip(a, b)), [(x, y) for x, y in zip(a, b) if x != y][:3]
