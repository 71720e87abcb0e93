"""Exact deduplication on DataFrame operations alone.

Texts are grouped by the 128-bit hash of their normalised form. The normalised text itself is part of the grouping key, so
the aggregation compares bytes inside each hash group and a collision gives two classes; copies collapse in the map tasks
before the only shuffle that carries texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ._common import written

#: Copies of a row that come out of one.
COPIES = 1 << 16
_BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _BLANKS, "")


def content_hash(norm: Column) -> Column:
    return F.md5(norm.cast("binary"))


def exact_classes(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Of equal texts, the row with the most code points in the original text stays, of these the one with the smallest
    doc_id. A null text equals an empty one; a null doc_id is the smallest; of repeated rows with the id that stays, one is
    marked kept; an empty table gives an empty result. Other columns aren't read.
    """
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("hash", digest(F.col("norm")))

    def grouped(rows: DataFrame) -> DataFrame:
        best = F.min(F.struct((-F.col("size")).alias("size"), "doc_id"))
        return rows.groupBy("hash", "norm").agg(F.count("*").alias("group_size"), best.alias("best"))

    def units(rows: DataFrame, *key: str) -> DataFrame:
        """Rows that agree in id, size and text, as one with their number."""
        return rows.groupBy("doc_id", "size", *key).agg(F.count("*").alias("copies"))

    def judged(rows: DataFrame) -> DataFrame:
        kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("size") == -F.col("best.size"))
        # Copies come out again in parts, so that no row holds them all; the first of them may stay.
        rows = rows.withColumn("kept", kept).withColumn("last", F.col("copies") - 1)
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - F.col("last") % COPIES, F.lit(COPIES).cast("long"))))
        rows = rows.withColumn("copy", F.explode(F.sequence("part", F.least("last", F.col("part") + COPIES - 1))))
        return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("kept") & (F.col("copy") == 0)).alias("kept"), "text_sha256")

    classes = written(grouped(rows).select("hash", F.sha2("norm", 256).alias("text_sha256"), "group_size", "best"), "classes")
    # A hash that stands for one text only joins by itself; texts of colliding hashes join by their bytes.
    collided = classes.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash")
    if collided.isEmpty():
        return judged(units(rows, "hash").join(classes, "hash"))
    apart = rows.join(collided, "hash", "left_semi")
    exact = units(apart, "hash", "norm").join(grouped(apart), ["hash", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
    single = units(rows, "hash").join(classes.join(collided, "hash", "left_anti"), "hash")
    return judged(single).unionByName(judged(exact))


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of `docs` that stay, one of each text, whatever the ids: the row that exact_classes marks kept.

    Rows are judged one by one by (doc_id, text, size), a null doc_id equal to itself; of rows that agree in all three, one
    stays. The texts are shuffled by these, so rows of a large group are dealt over all tasks.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("hash", digest(F.col("norm")))
    best = F.min(F.struct((-F.col("size")).alias("size"), "doc_id")).alias("best")
    classes = written(rows.groupBy("hash", "norm").agg(best).select("hash", F.sha2("norm", 256).alias("sha"), "best"), "classes")
    # The text's SHA-256 goes into the name only where some hash stands for several texts.
    collided = not classes.groupBy("hash").count().where("count > 1").isEmpty()
    sha = lambda c: F.col(c) if c == "sha" else F.sha2(c, 256)
    name = lambda doc_id, size, c: F.struct(doc_id.alias("doc_id"), size.alias("size"), "hash", *([sha(c).alias("sha")] if collided else [])).alias("name")
    keep = classes.select(name(F.col("best.doc_id"), -F.col("best.size"), "sha"))
    return rows.select(name(F.col("doc_id"), F.col("size"), "norm"), "row").join(keep, "name", "left_semi").dropDuplicates(["name"]).select("row.*")
