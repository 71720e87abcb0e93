"""Sources. All reads go through Spark's readers, so any store that Spark knows will do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The header line of a signal file.
SIGNAL_HEADER = "Sample;Time (s);CURRENT (V);ROTO (V)"


def scan_signal_text(spark: SparkSession, path: str, acquisition: Column | None = None) -> DataFrame:
    """(acquisition_id, sample, t, ch_a, ch_b) of semicolon files: lines whose first field is a whole number are samples.

    Preamble and header lines have none, so line numbers aren't needed; the acquisition is the partition folder's value or
    the file's name, or what `acquisition` makes of the line `value`, for files that hold many.
    """
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_name"))
    if acquisition is None:
        acquisition = F.col("acquisition_id") if "acquisition_id" in lines.columns else F.col("_file")
    f = F.split("value", ";")
    number = lambda k: F.get(f, F.lit(k)).try_cast("double")
    rows = lines.select(acquisition.alias("acquisition_id"), F.get(f, F.lit(0)).try_cast("long").alias("sample"), number(1).alias("t"), number(2).alias("ch_a"), number(3).alias("ch_b"))
    return rows.where("sample IS NOT NULL")


def files_without_header(spark: SparkSession, path: str, header: str = SIGNAL_HEADER) -> DataFrame:
    """(file) names of signal files that lack the header line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.btrim("value") == header).alias("hit"))
    return lines.groupBy("file").agg(F.bool_or("hit").alias("hit")).where("NOT hit").select("file")


def scan_class_files(spark: SparkSession, path: str, schema: T.StructType, classes: dict[str, str], pattern: str, id_column: str) -> DataFrame:
    """CSV rows with canonical_class, from the part of the file's path that the pattern's group 1 takes, and case_id `part:id`."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    known = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    df = df.withColumn("_part", name)
    return df.withColumn("canonical_class", F.try_element_at(known, F.col("_part"))).withColumn("case_id", F.concat_ws(":", "_part", F.col(id_column).cast("string"))).drop("_part")


# Names of label columns, and the tokens of group columns.
LABEL_NAMES = ("label", "class", "class_label", "target", "mktsegment")
GROUP_TOKENS = ("group", "run", "batch", "key", "id")


def scan_csv_table(spark: SparkSession, path: str, label: str | None = None) -> tuple[DataFrame, str | None, list[str]]:
    """(all-text table, label column, group candidates) of a CSV with header; the label is the given or the first known name."""
    df = spark.read.option("header", True).csv(path)
    found = label or next((c for c in df.columns if c.lower() in LABEL_NAMES), None)
    return df, found, [c for c in df.columns if c != found and any(t in c.lower() for t in GROUP_TOKENS)]


def scan_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet files or globs as one table; order is a matter of keys, not of paths."""
    return spark.read.parquet(*paths)


def scan_json_docs(spark: SparkSession, path: str, schema: T.StructType, nested: str) -> DataFrame:
    """A JSON document, or an array of them, a file: their plain fields and those of the nested one, flat.

    A file is read in one task, so many small documents are best kept as arrays of some thousands.
    """
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(*[c for c in df.columns if c != nested], f"{nested}.*")


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of JSON lines; blank lines are skipped, lines that aren't objects of the schema are rejected."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    return parsed.where(~bad).select(*[f"r.{f.name}" for f in schema.fields]), parsed.where(bad).select("value")


def explode_json_payload(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The table with the JSON column's fields as typed columns instead of it."""
    return df.withColumn("_j", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "_j.*")


#: Files up to this size are hashed in a row, larger ones as a stream of chunks of CHUNK bytes.
WHOLE, CHUNK = 1 << 28, 1 << 23


def checksum_manifest(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """(path, size, md5, sha256) of files of any size, each hashed in one task.

    Files over `whole` bytes are read in chunks, never held as a whole, through the file systems that Arrow knows (local and
    shared folders, HDFS, object stores). Spark's reader doesn't list files without content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    short = F.regexp_extract("path", r"([^/]+/?[^/]+)$", 1).alias("path")
    small = files.where(F.col("length") <= whole).select(short, F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for uri in b["uri"]:
                store, name = (fs.LocalFileSystem(), uri.removeprefix("file:")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
                md5, sha = hashlib.md5(), hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while chunk := f.read(CHUNK):
                        md5.update(chunk)
                        sha.update(chunk)
                out.append((md5.hexdigest(), sha.hexdigest()))
            yield b.assign(md5=[x for x, _ in out], sha256=[x for _, x in out])[["path", "size", "md5", "sha256"]]

    large = files.where(F.col("length") > whole).select(short, F.col("length").alias("size"), F.col("path").alias("uri"))
    return small.unionByName(large.mapInPandas(run, "path string, size long, md5 string, sha256 string"))
