"""Run a registered query on Spark and its SQL on DuckDB and compare the full results."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.6g}" if not float(v).is_integer() or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    got_cols = df.columns
    got = table(got_cols, df.collect())
    res = con.execute(sql)
    want_cols = [c[0] for c in res.description]
    want = table(want_cols, res.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; spark {got[:2]} sql {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (not bad), f"{len(got)} rows" if not bad else f"{len(bad)}/{len(got)} differ: {sorted(got_cols)} {bad[:2]}"
