"""Runs a query and its SQL over the same tables and compares names, types and values."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

from tessera.session import TABLES

#: DuckDB types that mean the same as a Spark type.
SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def _rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 5) + 0.0
        return None if v is None or v is pd.NA or v is pd.NaT else v

    return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=str)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs, empty if nothing does."""
    want = con.execute(sql)
    names = {d[0]: str(d[1]) for d in want.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    for name, kind in df.dtypes:
        if SAME.get(kind, kind).upper() != names[name].upper():
            return f"{name} is {kind} and {names[name]}"
    got, expected = _rows(df.toPandas(), sorted(names)), _rows(want.df(), sorted(names))
    if got != expected:
        return f"{len(got)} and {len(expected)} rows; only here {[r for r in got if r not in expected][:3]}, only there {[r for r in expected if r not in got][:3]}"
    return "" if got else "no rows"


def sf_dirs() -> list[str]:
    return sorted(glob.glob("/root/testdata/sf*"))
