"""Sharding by proportional stratified interleaving, on DataFrame operations alone.

Rows are shuffled within their source by a seeded hash. A row's fractional rank is its rank over the rows of its source, so
sources interleave in proportion, and cutting the order of fractional ranks into equal parts gives shards that all have the
mixture of the whole. Both rankings go by ranges, of the hash and of the fractional rank, which are even however large one
source is: counts a range, prefix sums over the ranges, and windows inside them. Nothing is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._common import written

SHARDS, SEED = 8, 42
#: Hexadecimal digits of the hash that make a bucket of a source, ranges of the fractional rank, and copies dealt out at once.
BUCKET_DIGITS, RANGES, COPIES = 3, 4096, 1 << 16


def shuffled(docs: DataFrame, seed: int = SEED, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """(source, bucket, key, doc_id, size, text_crc32, copies): rows with their seeded key, equal ones together.

    The key is the MD5 of seed, doc_id and the text's MD5.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text)).cast("binary"))
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select("source", key.alias("key"), "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("source", "key", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    return rows.withColumn("bucket", F.substring("key", 1, bucket_digits))


def _before(n: str, of: list[str], *by: str) -> Column:
    """Sum of `n` over what lies before in the order."""
    return F.coalesce(F.sum(n).over(W.partitionBy(*of).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def interleaved(docs: DataFrame, seed: int = SEED, bucket_digits: int = BUCKET_DIGITS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, source, size, text_crc32, place, total): each row's place, from 0, in the order of fractional ranks."""
    units = written(shuffled(docs, seed, bucket_digits), "shuffled")
    buckets = units.groupBy("source", "bucket").agg(F.sum("copies").alias("held"))
    starts = buckets.select(F.col("source").alias("of"), F.col("bucket").alias("b"), _before("held", ["source"], "bucket").alias("before"), F.sum("held").over(W.partitionBy("source")).alias("rows"))
    order = ["key", "doc_id", "size", "text_crc32"]
    inside = _before("copies", ["source", "bucket"], *order)
    units = units.withColumn("inside", inside).join(starts, units.source.eqNullSafe(starts.of) & (units.bucket == starts.b)).drop("of", "b")
    # Copies of a row follow each other: dealt out in parts, so that no row holds them all.
    last = (F.col("copies") - 1).cast("long")
    units = units.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last - last % COPIES, F.lit(COPIES).cast("long"))))
    units = units.withColumn("copy", F.explode(F.sequence("part", F.least(last, F.col("part") + COPIES - 1))))
    twice = 2 * (F.col("before") + F.col("inside") + F.col("copy")) + 1
    rows = units.select("doc_id", "source", "key", "size", "text_crc32", "copy", (twice / (2 * F.col("rows")).cast("double")).alias("share"))
    rows = written(rows.withColumn("range", F.floor(F.col("share") * ranges).cast("int")), "interleaved")
    held = rows.groupBy("range").agg(F.count("*").alias("held"))
    # A fixed number of ranges: one window over so many counts.
    starts = held.select(F.col("range").alias("r"), _before("held", [], "range").alias("before"), F.sum("held").over(W.partitionBy()).alias("total"))
    nth = F.row_number().over(W.partitionBy("range").orderBy("share", F.col("source").asc_nulls_last(), *order[:1], "copy")) - 1
    rows = rows.withColumn("nth", nth).join(starts, F.col("range") == F.col("r"))
    return rows.select("doc_id", "source", "size", "text_crc32", (F.col("before") + F.col("nth")).alias("place"), "total")


def shards(docs: DataFrame, n: int = SHARDS, seed: int = SEED, bucket_digits: int = BUCKET_DIGITS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row; counts of shards are at most one apart.

    A null text has no bytes (size 1), a null source is a source, repeated rows count each, an empty table gives an empty result.
    The order depends on seed, ids, texts and sources alone, so reruns agree; rows equal in all three are interchangeable.
    Sources of m rows have m / n of them in every shard, give or take one. Equal texts aren't held together: the law is `rows`.
    """
    rows = interleaved(docs, seed, bucket_digits, ranges)
    shard = F.call_function("div", F.col("place") * n, F.col("total"))
    first = F.call_function("div", F.col("shard") * F.col("total") + n - 1, F.lit(n).cast("long"))
    rows = rows.withColumn("shard", shard)
    return rows.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))
