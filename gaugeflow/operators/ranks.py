"""Exact ranks and medians of continuous values, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.storage import stored


def same(a: DataFrame, b: DataFrame, columns: dict[str, str]) -> Column:
    """Equality of columns of two tables, nulls equal to each other."""
    return reduce(Column.__and__, [a[x].eqNullSafe(b[y]) for x, y in columns.items()])


def cumulative(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """(by, value, n, upto, total) for a table with one row for each (by, value): the sum of `n` up to the value, and of its group.

    Values are dealt out by ranges, whose bounds Spark samples, so a group that holds all rows is spread over all tasks. Sums
    by range come first, a window over these sums gives what lies before a range, and windows inside the ranges the rest.
    """
    rows = stored(counts.select(*by, value, n).repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    held = rows.groupBy(*by, "_range").agg(F.sum(n).alias("_held"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("_held").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*[F.col(b).alias(f"_of_{b}") for b in by], F.col("_range").alias("_of_range"), before.alias("_before"), F.sum("_held").over(group).alias("total"))
    inside = F.sum(n).over(W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_inside", inside)
    joined = rows.join(held, same(rows, held, {b: f"_of_{b}" for b in by} | {"_range": "_of_range"}))
    return joined.select(*by, value, n, (F.col("_before") + F.col("_inside")).alias("upto"), "total")


def medians(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name, median): the exact median of each column's values that aren't null, as doubles; a column without any has no row."""
    cell = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), c.cast("double").alias("value")) for name, c in columns.items()]))
    counts = df.select(cell.alias("c")).select("c.*").where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    places = cumulative(counts, ["name"], "value")
    at = lambda k: F.max(F.when((F.col("upto") - F.col("n") < k) & (k <= F.col("upto")), F.col("value")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return places.groupBy("name").agg((0.5 * at(low) + 0.5 * at(high)).alias("median"))
