"""Sinks, registries and idempotent appends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.columns import content_hash


def write_parquet_partitioned(df: DataFrame, path: str, by: Sequence[str], compression: str = "zstd") -> int:
    """Write and count in one pass; an error if nothing was written. Spark's commit protocol makes the replacement atomic."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", compression).partitionBy(*by).parquet(path)
    rows = seen.get["rows"]
    if not rows:
        raise ValueError("nothing to write")
    return rows


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    df.select(*(fields or df.columns)).write.mode("overwrite").json(path)


def union_of_keys(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows with all columns, null where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def idempotent_append(stored: DataFrame, new: DataFrame, key: Sequence[str], content: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): known keys with the same content are skipped, with another one they conflict."""
    fresh = new.join(stored, list(key), "left_anti")
    s = stored.select(*key, F.col(content).alias("_stored"))
    conflicts = new.join(s, list(key)).where(~F.col(content).eqNullSafe(F.col("_stored"))).drop("_stored")
    return fresh, conflicts


def append_rows(new: DataFrame, path: str, key: Sequence[str], content: str) -> DataFrame:
    """Append to the Parquet table at `path` the rows whose key it doesn't hold yet; gives the conflicts, which stay out.

    A second append of the same rows adds nothing. Repeated rows are appended once; the rows of a key that the new ones give
    several contents are conflicts. A path without a table is an empty one. One writer at a time is assumed.
    """
    spark = new.sparkSession
    try:
        held = spark.read.parquet(path).select(*key, content)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = new.select(*key, content).limit(0)
    clear = new.groupBy(*key).agg((~F.min(content).eqNullSafe(F.max(content)) | (F.count(content) != F.count("*")) & (F.count(content) > 0)).alias("_several"))
    marked = new.join(clear, list(key))
    fresh, conflicts = idempotent_append(held, marked.where("NOT _several").drop("_several"), key, content)
    fresh.dropDuplicates([*key, content]).write.mode("append").parquet(path)
    return conflicts.unionByName(marked.where("_several").drop("_several"))


def table_registry(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, records, digest): the digest doesn't depend on the order of rows.

    It is the SHA-256 of the count and the sum of 52-bit hashes of the rows, so nothing is gathered.
    """
    out = []
    for name, df in tables.items():
        h = F.conv(F.substring(content_hash(*df.columns), 1, 13), 16, 10).cast("decimal(38,0)")
        g = df.agg(F.count("*").alias("records"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("s"))
        out.append(g.select(F.lit(name).alias("table"), "records", content_hash("records", "s").alias("digest")))
    return reduce(DataFrame.unionAll, out)


def compare_checksums(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of files that changed, vanished or are new between two manifests (path, sha256)."""
    j = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer").where("NOT (a <=> b)")
    return j.select("path", F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "MISSING").otherwise("CHANGED").alias("status"))
