"""Comparison of a query with its DuckDB equivalent on one directory of tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        inner = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{inner}')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), sorted(columns)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, named = rows_of([c[0] for c in cur.description], cur.fetchall())
    if names != named:
        return f"columns {names} != {named}"
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} wanted"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else None
