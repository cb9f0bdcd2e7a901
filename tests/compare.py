"""Holds a registered query against its oracle SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def oracle(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con.execute(sql).df()


def same(df, sql: str, sf: str) -> None:
    got, want = df.toPandas(), oracle(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
