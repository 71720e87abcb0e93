"""Comparison with a healthy reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import finite, first_reason


def fit_reference(df: DataFrame, view: Sequence[str], baseline: str, x: str = "x") -> DataFrame:
    """(view, mean, scale): by position over the training rows of the baseline class; a population std of 0 counts as 1."""
    cells = df.where((F.col("split_role") == "train") & (F.col("canonical_class") == baseline)).select(*view, F.posexplode(x).alias("at", "v"))
    s = cells.groupBy(*view, "at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    a = s.groupBy(*view).agg(F.array_sort(F.collect_list(F.struct("at", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("t"))
    return a.select(*view, F.transform("t", lambda t: t["m"]).alias("mean"), F.transform("t", lambda t: t["s"]).alias("scale"))


def reference_distance(df: DataFrame, reference: DataFrame, view: Sequence[str], x: str = "x", out: str = "healthy_distance") -> DataFrame:
    """Rows with sqrt(mean(((x - mean) / scale)^2)); null where the view has no reference."""
    j = df.join(reference, list(view), "left")
    z = F.zip_with(F.zip_with(x, "mean", lambda a, b: a - b), "scale", lambda a, b: a / b)
    d = F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))
    return j.withColumn(out, d).drop("mean", "scale")


def validate_reference(reference: DataFrame, width: int, assignment: str | None = None) -> DataFrame:
    """The table with `status`: REFERENCE_OK, or the code of the first thing that is wrong.

    Needs mean and scale; looks at source_partitions, at assignment_id against the column `assignment`, and at
    source_window_hashes where the table has them.
    """
    have = set(reference.columns)
    no = lambda c: F.coalesce(c, F.lit(True))
    hashes = "source_window_hashes" in have
    checks = []
    if "source_partitions" in have:
        checks.append((no(F.col("source_partitions") != F.array(F.lit("train"))), "HEALTHY_REFERENCE_MUST_BE_TRAINING_ONLY"))
    if assignment:
        checks.append((no((F.col("assignment_id") == "") | (F.col("assignment_id") != F.col(assignment))), "HEALTHY_REFERENCE_ASSIGNMENT_MISMATCH"))
    shape = no(F.size("mean") != width) | no(F.size("scale") != width)
    if hashes:
        shape = shape | no(F.size("source_window_hashes") < 1)
    checks.append((F.col("mean").isNull() | F.col("scale").isNull() | shape, "HEALTHY_REFERENCE_PROVENANCE_OR_SHAPE_INVALID"))
    checks.append((F.exists("mean", lambda v: ~finite(v)) | F.exists("scale", lambda v: ~finite(v) | (v <= 0)), "HEALTHY_REFERENCE_VALUES_INVALID"))
    if hashes:
        checks.append((no(F.exists("source_window_hashes", lambda h: no(~h.rlike("^[0-9a-f]{64}$")))), "HEALTHY_REFERENCE_SOURCE_HASH_INVALID"))
    return reference.withColumn("status", first_reason(*checks, ok="REFERENCE_OK"))


def fit_series_reference(series: DataFrame) -> DataFrame:
    """(position, m, s) of the baseline series (series_id, position, v)."""
    g = series.groupBy("position").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return g.select("position", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))


def series_distance_area(series: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, distance, area): root mean square z-distance, and the trapezoid area of |v - mean| at unit spacing."""
    j = series.join(reference, "position")
    d = F.abs(F.col("v") - F.col("m"))
    before = F.lag("_d").over(W.partitionBy(key).orderBy("position"))
    j = j.withColumn("_d", d).withColumn("_t", (F.col("_d") + before) / 2)
    z = (F.col("v") - F.col("m")) / F.col("s")
    return j.withColumn("_z2", z * z).groupBy(key).agg(F.sqrt(F.avg("_z2")).alias("distance"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("area"))


def first_crossing(series: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, crossing): the first position whose value reaches the threshold, null if none does."""
    return series.groupBy(key).agg(F.min(F.when(F.col("v") >= threshold, F.col("position"))).alias("crossing"))
