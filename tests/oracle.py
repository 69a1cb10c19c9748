"""Compares a query with its SQL in DuckDB, as the driver does: same columns, same rows in any order."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder):
    con = duckdb.connect()
    for t in TABLES:
        f = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return con


def plain(value, is_float):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, list | np.ndarray):
        return str([plain(v, False) for v in value])
    if is_float:
        return float(f"{float(value):.9g}")
    return bool(value) if isinstance(value, bool | np.bool_) else int(value) if isinstance(value, int | np.integer) else str(value)


def table(pdf, columns, floats):
    return sorted((tuple(plain(v, c in floats) for c, v in zip(columns, r)) for r in pdf[columns].itertuples(index=False)), key=str)


def same(df, sql, con):
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    floats = {c for c in columns if "f" in (got[c].dtype.kind, want[c].dtype.kind)}
    a, b = table(got, columns, floats), table(want, columns, floats)
    assert len(a) == len(b)
    assert a == b


def rows(df, *order):
    """Rows as tuples, sorted by the named columns or whole."""
    found = [tuple(r) for r in df.collect()]
    at = [df.columns.index(c) for c in order] or range(len(df.columns))
    return sorted(found, key=lambda r: [(r[i] is not None, r[i]) for i in at])
