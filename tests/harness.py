"""Runs registered queries against their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = pathlib.Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def key(row):
    return tuple((x is None, str(type(x)), round(x, 5) if isinstance(x, float) else x)
                 if not isinstance(x, tuple) else (False, "t", str(x)) for x in row)


def rows_of_spark(df):
    cols = sorted(df.columns)
    out = [tuple(norm(v) for v in r) for r in df.select(*cols).collect()]
    return cols, sorted(out, key=key)


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(out, key=key)


def close(a, b, tol=1e-9):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y, tol) for x, y in zip(a, b))
    return type(a) is type(b) and a == b


def compare(spark_df, con, sql):
    """Returns (problem or None, number of rows, number of rows not bit-equal)."""
    c1, r1 = rows_of_spark(spark_df)
    c2, r2 = rows_of_duck(con, sql)
    if c1 != c2:
        return f"columns {c1} != {c2}", len(r1), 0
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}; {r1[:2]} {r2[:2]}", len(r1), 0
    loose = 0
    for a, b in zip(r1, r2):
        if a != b:
            loose += 1
            if not all(close(x, y) for x, y in zip(a, b)):
                return f"first difference {dict(zip(c1, a))} != {dict(zip(c1, b))}", len(r1), loose
    return None, len(r1), loose
