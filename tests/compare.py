"""Run a registered query and its SQL side by side and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**8 else str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if hasattr(v, "is_integer") or v.__class__.__name__ == "Decimal":
        return f"{float(v):.9g}"
    return v if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def kinds(columns, data):
    """Python type of every column, from its first value that is not NULL."""
    out = {}
    for i, c in enumerate(columns):
        out[c] = next((type(r[i]).__name__ for r in data if r[i] is not None), None)
    return out


def compare(spark, con, fn, sql, sf_dir) -> str | None:
    df = fn(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    got_cols, got = rows(df.columns, got_rows)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    want_cols, want = rows(cols, want_rows)
    a, b = kinds(df.columns, got_rows), kinds(cols, want_rows)
    if got_cols == want_cols and a != b:
        return f"types {({c: (a[c], b[c]) for c in a if a[c] != b[c]})}"
    if got_cols != want_cols:
        return f"columns {got_cols} <> {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {a} <> {b}"
    if not got:
        return "no rows"
    return None
