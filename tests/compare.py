"""Side-by-side comparison of a query with its SQL on DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def _plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return None if np.isnan(value) else float(value)
    if value is None or value is pd.NaT:
        return None
    return value


def rows(columns: list[str], data) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in data), key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def spark_rows(df) -> list[tuple]:
    return rows(df.columns, df.collect())


def assert_same(df, sql: str, sf_dir: str = DATA) -> int:
    con = duck(sf_dir)
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    got = spark_rows(df)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    return len(got)
