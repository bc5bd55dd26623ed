"""Strict comparison of a query with its oracle."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

from tidemark.plans.fixtures import BASE_TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("float", "nan")
        return ("float", repr(v + 0.0))
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, dt.datetime):
        return ("time", v.isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    if v is None:
        return ("null", "")
    if isinstance(v, str):
        return ("str", v)
    return (type(v).__name__, repr(v))


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [names[i] for i in order], out


def differences(df, con, sql, limit=3):
    """Empty list where both sides agree."""
    cur = con.execute(sql)
    names, rows = [d[0] for d in cur.description], cur.fetchall()
    want_names, want = canonical(names, rows)
    got_names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return [f"columns: got {got_names} want {want_names}"]
    if got == want:
        return []
    found = [f"rows: got {len(got)} want {len(want)}"]
    a, b = set(got), set(want)
    found += [f"only spark:  {r}" for r in sorted(a - b, key=repr)[:limit]]
    found += [f"only oracle: {r}" for r in sorted(b - a, key=repr)[:limit]]
    return found
