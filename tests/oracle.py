"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}" if v else "0"
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**8 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def both(spark, con, query, sql: str, folder: Path) -> tuple[list, list]:
    """Sorted rows of either side, columns by name."""
    df = query(spark, str(folder))
    cur = con.execute(sql)
    there = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(there)
    names = sorted(there)
    a = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    b = sorted(tuple(plain(r[there.index(c)]) for c in names) for r in cur.fetchall())
    return a, b
