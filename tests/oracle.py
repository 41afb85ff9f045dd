"""Runs registered queries against their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        return "~" if math.isnan(value) else f"n{value:.9g}"
    if isinstance(value, int):
        return f"n{float(value):.9g}"
    if isinstance(value, list):
        return str([_cell(v) for v in value])
    return f"s{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(con, spark, folder, name, build, sql):
    """(ok, message, rows, spark seconds)."""
    start = time.time()
    df = build(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, "no oracle", len(got), took
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}", len(got), took
    want = _rows(columns, cur.fetchall())
    if got == want:
        return True, "equal", len(got), took
    a, b = set(got), set(want)
    return False, (
        f"{len(got)} / {len(want)} rows; columns {sorted(columns)}; "
        f"only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    ), len(got), took
