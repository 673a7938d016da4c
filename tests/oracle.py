"""Spark result against DuckDB result of the same query, as multisets of rows with columns in the order of their names."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = rows(cols, res.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    if want != got:
        return f"{sum((got - want).values())} rows only in Spark, {sum((want - got).values())} only in SQL: {list((got - want))[:2]} / {list((want - got))[:2]}"
    return None
