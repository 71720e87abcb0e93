"""From window predictions to acquisitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import first_reason
from .ml import predict_records


def _by_class(k: int, make) -> Column:
    return F.array(*[make(i) for i in range(k)])


def _scaled(p: Column | str) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: x / total)


def aggregate_probability(predictions: DataFrame, keys: Sequence[str], classes: Sequence[str], how: str = "mean") -> DataFrame:
    """(keys, p) over each acquisition's windows, scaled to sum 1.

    how: `mean`, `median`, `majority` (share of predicted classes) or `confidence` (mean weighted by confidence; a weight
    of 0 in all gives null). All but the median combine before the shuffle.
    """
    k = len(classes)
    make = {
        "mean": lambda i: F.avg(F.col("p")[i]),
        "median": lambda i: F.median(F.col("p")[i]),
        "majority": lambda i: F.avg((F.col("predicted_class") == classes[i]).cast("double")),
        "confidence": lambda i: F.when(F.sum("confidence") > 0, F.sum(F.col("confidence") * F.col("p")[i]) / F.sum("confidence")),
    }[how]
    g = predictions.groupBy(*keys).agg(_by_class(k, make).alias("p"))
    return g.withColumn("p", _scaled("p"))


def window_lists(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, window_count, windows): the orders of an acquisition's windows, joined in order."""
    ids = F.transform(F.array_sort(F.collect_list("window_order")), lambda x: x.cast("string"))
    return predictions.groupBy(*keys).agg(F.count("*").alias("window_count"), F.array_join(ids, ",").alias("windows"))


def aggregate_evidence(predictions: DataFrame, keys: Sequence[str], classes: Sequence[str], how: str = "mean") -> DataFrame:
    """Full acquisition records: p, class, confidence, entropy, and how many windows were valid or not (p null)."""
    valid = F.col("p").isNotNull()
    n = predictions.groupBy(*keys).agg(F.count_if(valid).alias("valid_windows"), F.count_if(~valid).alias("invalid_windows"))
    p = predict_records(aggregate_probability(predictions.where(valid), keys, classes, how), classes)
    return n.join(p, list(keys), "left")


def homogeneity_check(predictions: DataFrame, keys: Sequence[str], single: Sequence[str]) -> DataFrame:
    """(keys, code): the first column that isn't the same in all of a group's windows, or repeated windows; null if fine."""
    g = predictions.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"_{c}") for c in single], F.count("*").alias("_n"), F.count_distinct("window_order").alias("_w"))
    return g.select(*keys, first_reason(*[(F.col(f"_{c}") > 1, f"MIXED_{c.upper()}") for c in single], (F.col("_n") != F.col("_w"), "DUPLICATED_WINDOW")).alias("code"))


def aggregation_equivalence(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-15) -> DataFrame:
    """(keys, largest_gap, equivalent) of two aggregations."""
    pack = lambda df, n: df.select(*keys, F.struct("p", "predicted_class").alias(n))
    gap = F.array_max(F.zip_with("x.p", "y.p", lambda u, v: F.abs(u - v)))
    j = pack(a, "x").join(pack(b, "y"), list(keys)).withColumn("largest_gap", gap)
    return j.select(*keys, "largest_gap", ((F.col("largest_gap") <= tolerance) & (F.col("x.predicted_class") == F.col("y.predicted_class"))).alias("equivalent"))
