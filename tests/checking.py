"""Compare a registered query with its checking SQL on one data folder."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    want_names, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_names != want_names:
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    if len(got) != len(want):
        extra = [r for r in got if r not in want][:2] if len(got) < 5000 else []
        lack = [r for r in want if r not in got][:2] if len(got) < 5000 else []
        return f"rows {len(got)} != {len(want)}; extra {extra}; lacking {lack}"
    for a, b in zip(got, want):
        if a != b:
            diff = [(n, x, y) for n, x, y in zip(got_names, a, b) if x != y]
            n_bad = sum(1 for x, y in zip(got, want) if x != y)
            return f"{n_bad} rows differ, first {diff} in {a[:6]}"
    return None
