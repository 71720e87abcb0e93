"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, as a character class of Java's and DuckDB's regular expressions.
SPACE = r"\x20\x09-\x0D"
#: Slices by hash in which a sample of labelled rows is taken.
SLICES = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`.

    Where it is unset, a session of one machine (tests) gets a new local folder; on a cluster that is an error, since
    executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(text: bytes, gap: re.Pattern, size: int = 1 << 20) -> Iterator[bytes]:
    """`text` in parts of about `size` bytes, cut where `gap` matches, so that no match of what isn't a gap is cut."""
    start = 0
    while len(text) - start > size:
        cut = gap.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def row_name() -> Column:
    """(doc_id, MD5 of the text): what tells rows apart, so that texts without an id or with a repeated one aren't taken for each other."""
    return F.struct("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("hash"))


def keep_least(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `docs` whose name is the least of its class, by a table (name, least) with a row for each of `docs`; one of equal rows."""
    classes = written(classes, "classes")
    gone = classes.where("name <> least").select("name").distinct()
    repeated = written(classes.where("name = least").groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name"), "repeated")
    named = docs.select(row_name().alias("name"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    kept = named.join(gone.union(repeated), "name", "left_anti")
    if not repeated.isEmpty():
        kept = kept.unionByName(named.join(repeated, "name", "left_semi").dropDuplicates(["name"]))
    return kept.select("row.*")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model learns labels from: crc32 of the id as text (a null one: empty), modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, shards: int) -> DataFrame:
    """(shard, y, text) of labelled rows outside the held-out fifth, at most about `max_rows` of them and `max_bytes` of text.

    Ids are picked from the labels by their hash, so the result doesn't depend on order or partitioning; an id with several
    labels counts as 1 if any is. The ids are cut into slices by hash, and as many whole slices are taken as hold the bytes.
    Where not even the first one fits (a labelled id in very many rows, giant texts), it is cut by the hash of its different
    texts, and one text, the shortest, is taken where none fits. What is picked is bounded, so its ids are broadcast; of the
    documents only the picked texts are shuffled.
    """
    marks = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    most = sample_limit(marks.count(), max_rows)
    picked = marks.where(place < most).withColumn("slice", F.floor(place / (most / SLICES)).cast("int"))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    held, taken, first = 0, 0, None
    for r in found.groupBy("slice").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("slice").collect():
        held += r["bytes"] or 0
        if held > max_bytes:
            first = r["slice"] if not taken else None
            break
        taken = r["slice"] + 1
    rows = found.where(F.col("slice") < taken)
    if first is not None:
        texts = written(found.where(F.col("slice") == first).select("y", "text").distinct(), "slice")
        size = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"]
        part = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * max_bytes / max(1, size))
        rows = texts.where(part & (F.octet_length("text") <= max_bytes))
        if rows.isEmpty():
            rows = texts.orderBy(F.octet_length("text"), "text", "y").limit(1)
    return rows.select(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), "y", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def sample_limit(total: int, max_rows: int) -> int:
    """The bound on 62-bit hashes under which about `max_rows` of `total` rows lie."""
    return max(SLICES, (1 << 62) * min(max_rows, max(1, total)) // max(1, total))
