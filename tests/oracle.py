"""Compare a Spark result with its SQL twin run by DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from hearthspan.sources.tables import TABLES


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)) if v is not None else "", v if v is not None else 0) for v in r))


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} duck {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
            return f"value {diff[:4]} in {dict(zip(got_cols, a))}"
    if not got:
        return "EMPTY (equal, but nothing checked)"
    return None
