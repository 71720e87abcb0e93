"""Profiles, schema discovery and data-quality predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import finite, first_reason, is_infinity, is_missing, normalized_entropy, or_null


def unpivot(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value) for every cell, as text; narrow, no shuffle."""
    columns = list(columns or df.columns)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("cell")).select("cell.*")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, rows, missing, infinite, present) of text columns."""
    missing, infinite = is_missing("value"), is_infinity("value")
    return unpivot(df, columns).groupBy("column_name").agg(F.count("*").alias("rows"), F.count_if(missing).alias("missing"), F.count_if(infinite).alias("infinite"), F.count_if(~missing).alias("present"))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, inferred) of text columns: integer, float, boolean or string by all values that aren't missing, else empty."""
    v = F.btrim("value")
    cells = unpivot(df, columns)
    every = lambda test: F.bool_and(F.when(~is_missing("value"), test))
    kinds = cells.groupBy("column_name").agg(every(v.rlike(r"^[+-]?[0-9]+$")).alias("i"), every(v.try_cast("double").isNotNull() | is_infinity("value")).alias("f"), every(F.lower(v).isin("true", "false")).alias("b"))
    return kinds.select("column_name", F.when(F.col("i").isNull(), "empty").when(F.col("i"), "integer").when(F.col("f"), "float").when(F.col("b"), "boolean").otherwise("string").alias("inferred"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(duplicate_rows): rows beyond the first of each set of equal rows; nulls are equal."""
    counts = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_names(header: DataFrame, column: str = "value", sep: str = ",") -> DataFrame:
    """(name, first_position, n) of names that a header line repeats."""
    names = header.select(F.posexplode(F.split(column, sep)).alias("at", "name"))
    return names.groupBy("name").agg(F.min("at").alias("first_position"), F.count("*").alias("n")).where("n > 1")


def class_distribution(df: DataFrame, label: str, known: Sequence[str]) -> DataFrame:
    """(label, n, status): counts of the known labels, zero where absent, and of unexpected ones."""
    spark = df.sparkSession
    names = spark.createDataFrame([(k,) for k in known], "label string")
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    j = counts.alias("c").join(names.alias("k"), F.col("c.label") == F.col("k.label"), "full_outer")
    return j.select(F.coalesce("k.label", "c.label").alias("label"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("k.label").isNull(), "UNEXPECTED").when(F.col("n").isNull(), "ABSENT").otherwise("EXPECTED").alias("status"))


def classify_columns(profile: DataFrame, groups: dict[str, Sequence[str]], identifiers: Sequence[str]) -> DataFrame:
    """Profile rows with the feature group whose tokens the lower-cased name holds (the first in order) and an identifier flag."""
    name = F.lower("column_name")
    has = lambda tokens: reduce(lambda a, b: a | b, [F.contains(name, F.lit(t)) for t in tokens])
    group = F.lit("other")
    for g, tokens in reversed(groups.items()):
        group = F.when(has(tokens), g).otherwise(group)
    return profile.withColumn("feature_group", group).withColumn("is_identifier", has(identifiers))


def file_inventory(present: DataFrame, expected: Sequence[str], column: str = "file_name") -> DataFrame:
    """(file_name, status): expected ones there or missing, and unexpected ones."""
    e = present.sparkSession.createDataFrame([(x,) for x in expected], "name string")
    j = present.select(column).distinct().join(e, F.col(column) == F.col("name"), "full_outer")
    return j.select(F.coalesce("name", column).alias("file_name"), F.when(F.col("name").isNull(), "UNEXPECTED").when(F.col(column).isNull(), "MISSING").otherwise("PRESENT").alias("status"))


def validate_tables(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(valid, reason_codes): codes of the checks whose table of violations has rows, sorted."""
    found = reduce(DataFrame.unionAll, [violations.limit(1).select(F.lit(code).alias("code")) for code, violations in checks])
    return found.agg(F.concat_ws(",", F.array_sort(F.collect_set("code"))).alias("reason_codes")).select((F.col("reason_codes") == "").alias("valid"), "reason_codes")


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, numeric): whether every value of a text column is a finite number."""
    number = finite(F.btrim("value").try_cast("double"))
    return unpivot(df, columns).groupBy("column_name").agg(F.bool_and(F.coalesce(number, F.lit(False))).alias("numeric"))


def feature_summary(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, rows, finite, lowest, highest, mean, std) with population std over the finite values."""
    cells = features.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("c")).select("c.*")
    x = or_null("x")
    return cells.groupBy("feature").agg(F.count("*").alias("rows"), F.count(x).alias("finite"), F.min(x).alias("lowest"), F.max(x).alias("highest"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def row_missing_ratio(df: DataFrame, columns: Sequence[str], out: str = "missing_ratio") -> DataFrame:
    """Share of a row's cells that are blank, not a number or infinite."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    bad = F.filter(cells, lambda v: F.coalesce(F.lower(F.btrim(v)).isin("", "nan"), F.lit(True)) | is_infinity(v))
    return df.withColumn(out, F.size(bad).cast("double") / len(columns))


def validate_signal_index(samples: DataFrame, expected: int | None = None) -> DataFrame:
    """(acquisition_id, n, contiguous, all_finite, ok): samples are 0 .. n - 1 and every value is finite."""
    values = [c for c in samples.columns if c not in ("acquisition_id", "sample")]
    bad = reduce(lambda a, b: a | b, [~finite(c) for c in values])
    g = samples.groupBy("acquisition_id").agg(F.count("*").alias("n"), F.min("sample").alias("lo"), F.max("sample").alias("hi"), F.count_distinct("sample").alias("k"), F.count_if(bad).alias("bad"))
    contiguous = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("k") == F.col("n"))
    ok = contiguous & (F.col("bad") == 0) & (F.lit(True) if expected is None else F.col("n") == expected)
    return g.select("acquisition_id", "n", contiguous.alias("contiguous"), (F.col("bad") == 0).alias("all_finite"), ok.alias("ok"))


def equal_classes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(k, n, columns) of the rows with equal values: the least key and how many they are. NaN and null are in none."""
    rows = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in columns]).where(reduce(lambda a, b: a & b, [finite(c) for c in columns]))
    return rows.groupBy(*columns).agg(F.min("k").alias("k"), F.count("*").alias("n"))


def near_duplicate_pairs(df: DataFrame, key: str, columns: Sequence[str], tolerance: float, cell: float, banded: int = 2) -> DataFrame:
    """(a, b, pairs) of classes of equal rows whose every column differs by `tolerance` at most: a banded join over cells of
    `cell` >= tolerance.

    a <= b are the least keys of the classes, `pairs` how many pairs of rows that is; a class of several rows is a pair with
    itself. Equal rows are never expanded into pairs. The first `banded` columns give the cells; one side looks into the
    neighbouring cells too.
    """
    if cell < tolerance:
        raise ValueError("cells must be as wide as the tolerance")
    names = list(columns)[:banded]
    rows = equal_classes(df, key, columns)
    at = [F.floor(F.col(c) / cell).cast("long") for c in names]
    left = rows.select(F.struct("k", "n", *columns).alias("l"), F.struct(*[a.alias(f"c{i}") for i, a in enumerate(at)]).alias("cell"))
    steps = F.array(*[F.struct(*[(a + s).cast("long").alias(f"c{i}") for i, (a, s) in enumerate(zip(at, step, strict=True))]) for step in product((-1, 0, 1), repeat=len(names))])
    right = rows.select(F.struct("k", "n", *columns).alias("r"), F.explode(steps).alias("cell"))
    close = reduce(lambda a, b: a & b, [F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= tolerance for c in columns])
    apart = left.join(right, "cell").where((F.col("l.k") < F.col("r.k")) & close).select(F.col("l.k").alias("a"), F.col("r.k").alias("b"), (F.col("l.n") * F.col("r.n")).alias("pairs"))
    within = rows.where("n > 1").select(F.col("k").alias("a"), F.col("k").alias("b"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return apart.unionAll(within)


def duplicate_analysis(df: DataFrame, key: str, columns: Sequence[str], tolerance: float, cell: float) -> DataFrame:
    """(exact_duplicates, near_pairs): surplus rows with equal values, and pairs within the tolerance (equal ones included)."""
    exact = duplicate_rows(df, columns).withColumnRenamed("duplicate_rows", "exact_duplicates")
    near = near_duplicate_pairs(df, key, columns, tolerance, cell).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("near_pairs"))
    return exact.crossJoin(near)  # one row each


def audit_checks(checks: Sequence[tuple[str, DataFrame, int]]) -> DataFrame:
    """(check, observed, expected, ok) of tables that each hold one number."""
    rows = [df.select(F.lit(name).alias("check"), F.col(df.columns[0]).cast("long").alias("observed"), F.lit(expected).cast("long").alias("expected")) for name, df, expected in checks]
    return reduce(DataFrame.unionAll, rows).withColumn("ok", F.col("observed").eqNullSafe(F.col("expected")))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: Names of fields that carry a label.
LABEL_FIELDS = ("label", "true_label", "ground_truth", "target", "y_true")


def label_leaks(df: DataFrame, payload: str, names: Sequence[str] = LABEL_FIELDS) -> DataFrame:
    """Rows with a flag whether a key of the JSON payload, at any depth, is a label field; null payloads don't have any.

    The payload's strings are read from left to right: a key is one that a colon follows, so that the text of a value is
    none. Keys are compared with their escapes resolved.
    """
    strings = F.regexp_extract_all(F.col(payload), F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+")(\s*:)?'), F.lit(0))
    keys = F.filter(strings, lambda t: t.endswith(":"))
    name = lambda t: F.get_json_object(F.concat(F.lit('{"k":'), F.regexp_replace(t, r"\s*:$", ""), F.lit("}")), "$.k")
    return df.withColumn("leaks", F.coalesce(F.exists(keys, lambda t: F.coalesce(name(t).isin(*names), F.lit(False))), F.lit(False)))


def reject_label_columns(df: DataFrame, names: Sequence[str] = LABEL_FIELDS) -> DataFrame:
    """The table itself; an error if a column, nested ones included, is a label field."""

    def walk(kind, path=""):
        for f in getattr(kind, "fields", []):
            if f.name in names:
                raise ValueError(f"label field {path}{f.name}")
            inner = getattr(f.dataType, "elementType", getattr(f.dataType, "valueType", f.dataType))
            walk(inner, f"{path}{f.name}.")

    walk(df.schema)
    return df


def window_contract(predictions: DataFrame, classes: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows with `rejection_code`: the first contract that a prediction breaks, null where it keeps them all."""
    p = F.col("p")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(p, F.array_max(p)).cast("int"))
    return predictions.withColumn(
        "rejection_code",
        first_reason(
            (p.isNull() | (F.size(p) != len(classes)), "PROBABILITY_LENGTH"),
            (F.exists(p, lambda x: ~finite(x)), "PROBABILITY_NOT_FINITE"),
            (F.exists(p, lambda x: (x < 0) | (x > 1)), "PROBABILITY_RANGE"),
            (F.abs(total - 1) > tolerance, "PROBABILITY_SUM"),
            (F.col("predicted_class") != best, "PREDICTION_NOT_ARGMAX"),
            (F.abs(F.col("confidence") - F.array_max(p)) > tolerance, "CONFIDENCE_MISMATCH"),
            (F.abs(F.col("entropy") - normalized_entropy(p)) > 1e-6, "ENTROPY_MISMATCH"),
        ),
    )


#: Partitions that evidence may come from.
PARTITIONS = ("train", "validation", "test", "production")


def provenance_contract(df: DataFrame, schema_version: str) -> DataFrame:
    """Rows with `rejection_code` for (schema_version, creator, created_at, input_hashes, partition)."""
    sha = F.exists("input_hashes", lambda h: ~h.rlike("^[0-9a-f]{64}$"))
    return df.withColumn(
        "rejection_code",
        first_reason(
            (~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "SCHEMA_VERSION"),
            (is_missing("creator"), "CREATOR_MISSING"),
            (F.try_to_timestamp("created_at").isNull(), "TIME_INVALID"),
            (F.coalesce(F.size("input_hashes"), F.lit(0)) < 1, "INPUT_HASH_MISSING"),
            (sha, "INPUT_HASH_FORMAT"),
            (~F.coalesce(F.col("partition").isin(*PARTITIONS), F.lit(False)), "PARTITION_UNKNOWN"),
        ),
    )


def dataset_audit(df: DataFrame, label: str, key: str) -> DataFrame:
    """(rows, columns, classes, duplicates, repeated_ids) of a table in one row."""
    rest = [c for c in df.columns if c != key]
    shape = df.agg(F.count("*").alias("rows"), F.count_distinct(label).alias("classes"))
    dup = duplicate_rows(df, rest)
    ids = repeated_keys(df, [key]).agg(F.count("*").alias("repeated_ids"))
    return shape.crossJoin(dup).crossJoin(ids).select("rows", F.lit(len(df.columns)).alias("columns"), "classes", "duplicate_rows", "repeated_ids")  # one row each


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("rejection_code").isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("rejection_code").isNotNull())

