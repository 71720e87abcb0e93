"""Evaluation aggregates over prediction rows (model, truth, predicted, p)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import ratio
from .ranks import cumulative


def join_labels(predictions: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions with the truth, which joins only now, `correct` and the category `truth->predicted`."""
    j = predictions.join(labels, list(key))
    return j.withColumn("correct", F.col("truth") == F.col("predicted")).withColumn("category", F.concat_ws("->", "truth", "predicted"))


def _names(spark, classes: Sequence[str], name: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in classes], f"{name} string")


def confusion_matrix(rows: DataFrame, classes: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, truth, predicted, n) for all pairs of classes, zero where no row has them."""
    spark = rows.sparkSession
    n = rows.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))
    cells = _names(spark, classes, "truth").crossJoin(_names(spark, classes, "predicted"))  # the classes, twice
    every = rows.select(*by).distinct().crossJoin(F.broadcast(cells)) if by else cells
    return every.join(n, [*by, "truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(confusion: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, class, precision, recall, f1, support); 0 / 0 is 0."""
    one = confusion.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit("t").alias("side")), F.struct(F.col("predicted").alias("class"), F.lit("p").alias("side")))).alias("c"), "n", (F.col("truth") == F.col("predicted")).alias("hit")).select(*by, "c.*", "n", "hit")
    s = lambda side, hit=None: F.sum(F.when((F.col("side") == side) & (F.lit(True) if hit is None else F.col("hit")), F.col("n")).otherwise(0))
    g = one.groupBy(*by, "class").agg(s("t", 1).alias("tp"), s("t").alias("support"), s("p").alias("chosen"))
    p, r = ratio("tp", "chosen"), ratio("tp", "support")
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*by, "class", "precision", "recall", "f1", "support")


def summary_metrics(confusion: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, accuracy, balanced_accuracy, macro_f1): recall is averaged over classes that occur, F1 over all."""
    rep = class_report(confusion, by).groupBy(*by).agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    acc = confusion.groupBy(*by).agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return acc.join(rep, list(by))


def _p_true(classes: Sequence[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("truth"))
    return F.get("p", at.cast("int") - 1)


def log_loss(rows: DataFrame, classes: Sequence[str], by: Sequence[str] = ("model",), least: float = 1e-15) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(-F.ln(F.greatest(_p_true(classes), F.lit(least)))).alias("log_loss"))


def brier(rows: DataFrame, classes: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean over rows of the sum over classes of (p - 1[class is true])^2."""
    names = F.array(*[F.lit(c) for c in classes])
    d = F.zip_with("p", names, lambda p, c: p - F.when(c == F.col("truth"), 1.0).otherwise(0.0))
    return rows.groupBy(*by).agg(F.avg(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)).alias("brier"))


def calibration_error(rows: DataFrame, by: Sequence[str] = ("model",), bins: int = 10) -> DataFrame:
    """(by, ece): equal bins of confidence, the last closed; weighted mean distance of accuracy and confidence."""
    conf = F.array_max("p")
    b = rows.withColumn("_b", F.least(F.floor(F.round(conf * bins, 9)), F.lit(bins - 1)))
    g = b.groupBy(*by, "_b").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("acc"), F.avg(conf).alias("conf"))
    return g.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def mean_max_probability(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.array_max("p")).alias("mean_max_probability"))


def metrics_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value) of a table with a column a metric."""
    rest = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in rest]).unpivot(list(keys), rest, "metric", "value")


def metrics_by_group(long: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """A row a group, a column a metric: the mean over the rest."""
    return long.groupBy(group).pivot("metric", list(metrics)).agg(F.avg("value"))


def metric_median(long: DataFrame, by: Sequence[str], exact: bool = True) -> DataFrame:
    """(by, median); the exact one sorts each group, the other is an approximate percentile for very large groups."""
    return long.groupBy(*by).agg((F.median("value") if exact else F.percentile_approx("value", 0.5, 10000).cast("double")).alias("median"))


def paired_levels(a: DataFrame, b: DataFrame, key: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """(key, level, value) of two tables with the same keys, and rows with level `UNPAIRED` for keys that one lacks."""
    j = a.select(*key, F.col("value").alias("x")).join(b.select(*key, F.col("value").alias("y")), list(key), "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    two = F.array(F.struct(F.lit(names[0]).alias("level"), F.col("x").alias("value")), F.struct(F.lit(names[1]).alias("level"), F.col("y").alias("value")))
    lone = F.array(F.struct(F.lit("UNPAIRED").alias("level"), F.coalesce("x", "y").alias("value")))
    return j.select(*key, F.explode(F.when(both, two).otherwise(lone)).alias("r")).select(*key, "r.*")


def sum_confusions(confusions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Element-wise sum of long matrices."""
    return confusions.groupBy(*by, "truth", "predicted").agg(F.sum("n").alias("n"))


def prediction_spread(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, measure, value): confidence and normalised entropy, one below the other."""
    return predictions.unpivot(list(keys), ["confidence", "entropy"], "measure", "value")


def component_ecdf(long: DataFrame, component: str = "component", value: str = "value") -> DataFrame:
    """(component, value, cumulative): the step function at each different value.

    Counts by value come first, and are summed up by ranges of the value, so that no task has a whole component.
    """
    n = long.groupBy(component, value).agg(F.count("*").alias("n"))
    return cumulative(n, [component], value).select(component, value, (F.col("upto") / F.col("total")).alias("cumulative"))


def saturation(long: DataFrame, component: str = "component", value: str = "value") -> DataFrame:
    """(component, saturated, distinct_values): share of values that are 1, and how many values differ."""
    return long.groupBy(component).agg(F.avg((F.col(value) == 1.0).cast("double")).alias("saturated"), F.count_distinct(value).alias("distinct_values"))


def component_means(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(component, keys, mean): by component, and by component and each key, in one pass of grouping sets."""
    sets = [["component"], *[["component", k] for k in keys]]
    return long.groupingSets(sets, "component", *keys).agg(F.avg(value).alias("mean"))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts, a row a value of `rows` and a column a value of `columns`; 0 where none."""
    out = df.groupBy(rows).pivot(columns, list(values)).count()
    return out.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])


def similarity_matrix(pairs: DataFrame, value: str = "jaccard") -> DataFrame:
    """(complete, unit_diagonal, symmetric, lowest, median, highest) of long pairs (a, b, value); the last three over a < b."""
    n = pairs.select("a").distinct().agg(F.count("*").alias("k"))
    back = pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col(value).alias("other"))
    j = pairs.join(back, ["a", "b"], "left")
    upper = F.when(F.col("a") < F.col("b"), F.col(value))
    s = j.agg(F.count("*").alias("n"), F.bool_and(F.when(F.col("a") == F.col("b"), F.abs(F.col(value) - 1) < 1e-12)).alias("unit_diagonal"), F.bool_and(F.coalesce(F.abs(F.col(value) - F.col("other")) < 1e-12, F.lit(False))).alias("symmetric"), F.min(upper).alias("lowest"), F.median(upper).alias("median"), F.max(upper).alias("highest"))
    return s.crossJoin(n).select((F.col("n") == F.col("k") * F.col("k")).alias("complete"), "unit_diagonal", "symmetric", "lowest", "median", "highest")  # one row each


def similarity_histogram(pairs: DataFrame, bins: int = 20, value: str = "jaccard") -> DataFrame:
    """(bin, n) of the upper triangle, the last bin closed."""
    b = F.least(F.floor(F.round(F.col(value) * bins, 9)), F.lit(bins - 1)).cast("int")
    return pairs.where("a < b").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def tie_stacks(df: DataFrame, group: Sequence[str], value: str, key: str) -> DataFrame:
    """The table with `stack`: how many equal values (to nine decimals) of the group come before, by key."""
    w = W.partitionBy(*group, F.round(value, 9)).orderBy(key)
    return df.withColumn("stack", (F.row_number().over(w) - 1).cast("long"))


def order_by_list(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The table with `position` in the list, unknown values last, sorted by it."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.withColumn("position", F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.lit(len(order)))).orderBy("position")


def contribution_extremes(contributions: DataFrame, k: int, value: str = "contribution", key: str = "feature") -> DataFrame:
    """The k lowest and k highest rows, each once: two top-k reports."""
    low, high = contributions.orderBy(F.col(value), key).limit(k), contributions.orderBy(F.col(value).desc(), key).limit(k)
    return low.union(high).distinct()
