"""Runs a registered query in Spark and its SQL in DuckDB and compares them."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql) -> str:
    """Empty when equal, else what differs."""
    scols, srows = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    dcols, drows = canonical([c[0] for c in cur.description], cur.fetchall())
    if scols != dcols:
        return f"columns {scols} != {dcols}"
    if len(srows) != len(drows):
        return f"rows {len(srows)} != {len(drows)}"
    if not srows:
        return "both empty"
    left, right = Counter(map(repr, srows)), Counter(map(repr, drows))
    if left != right:
        a, b = sorted((left - right).elements()), sorted((right - left).elements())
        types = [(c, type(x).__name__, type(y).__name__) for c, x, y in zip(scols, srows[0], drows[0]) if type(x) is not type(y)]
        return f"{len(a)} of {len(srows)} rows differ, types {types}\n  {scols}\n  {a[0]}\n  {b[0]}"
    return ""
