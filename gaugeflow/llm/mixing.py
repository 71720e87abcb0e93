"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are range-sorted by key within their source: equal ranges of the hash are the
buckets, so that no bucket grows beyond its share however large the source is. Prefix sums of sizes over the buckets and
then inside each bucket give each row's place, and the mix is cut at the source's exact budget. Whole epochs come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._common import SPACE

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size) with a row for each source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes; none gets more than
    `most` times its size, and the excess goes to the others by weight. That is min(level * weight, most * size), the level
    being found by prefix sums over the sources ordered by the level at which they fill up.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("w"))
    s = s.withColumn("full", F.col("source_size") * F.lit(most)).withColumn("at", F.col("full") / F.col("w"))
    filling = W.orderBy("at", F.col("source").asc_nulls_last())
    up, down = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (total - F.coalesce(F.sum("full").over(up), F.lit(0.0))) / F.sum("w").over(down))
    # The first source that isn't full at its level fixes the level of all that follow.
    s = s.withColumn("place", F.row_number().over(filling))
    level = F.min(F.when(F.col("at") >= F.col("level"), F.struct("place", "level"))).over(W.partitionBy())["level"]
    target = F.least(F.col("full"), F.coalesce(level, F.lit(0.0)) * F.col("w"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, bucket_digits: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row: the words that the mix takes of it, repeats counted.

    A row is taken once for each whole epoch of its source, and again in the last epoch up to the budget; the row at the cut
    is taken in part, so that each source meets its target rounded down. Null texts have size 0, a null source is a source,
    repeated rows count each; an empty table gives an empty result. The key is the MD5 of the doc_id and the text's MD5, so
    that rows of equal keys are equal and reruns agree, and rows without an id are dealt out like others.
    `bucket_digits` hexadecimal digits of it are the bucket.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.substring(key, 1, bucket_digits).alias("bucket"))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    plan = targets(buckets.groupBy("source").agg(F.sum("held").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    starts = buckets.select(F.col("source").alias("of"), F.col("bucket").alias("b"), before)
    inside = W.partitionBy("source", "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, rows.source.eqNullSafe(starts.of) & (rows.bucket == starts.b)).drop("of", "b")
    plan = plan.withColumnRenamed("source", "of")
    rows = rows.join(plan, rows.source.eqNullSafe(plan.of)).drop("of")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))
