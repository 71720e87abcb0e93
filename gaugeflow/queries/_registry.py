"""A query is a function (spark, sf_dir) -> DataFrame with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.adapters import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None, doubles: str = "", views: dict[str, str] | None = None):
    """Register a function. Its doubles, which `doubles` names for the SQL side, are rounded: sums differ in their last bits."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c), PLACES) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        name = f.__name__
        assert name not in QUERIES, name
        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            body = with_views(sql, views)
            rounded = ", ".join(f"round({c}, {PLACES}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            SQL[name] = f"SELECT * REPLACE ({rounded}) FROM ({body})" if rounded else body
        return run

    return register
