"""Profiles and data quality (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..plans import adapters as ad
from ..schemas import CLASSES
from ._registry import query

_CELLS = {"cells": "SELECT unnest(['custkey', 'nationkey', 'acctbal', 'mktsegment', 'flag', 'nothing']) AS column_name, unnest([custkey, nationkey, acctbal, mktsegment, flag, nothing]) AS value FROM raw_strings"}
_MISSING = "coalesce(lower(trim(value)) IN ('', 'na', 'nan', 'null', 'none'), true)"
_INF = "coalesce(lower(trim(value)) IN ('inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity'), false)"


@query(f"SELECT column_name, count(*) AS rows, count(*) FILTER ({_MISSING}) AS missing, count(*) FILTER ({_INF}) AS infinite, count(*) FILTER (NOT {_MISSING}) AS present FROM cells GROUP BY column_name", views=_CELLS)
def missing_profile(spark, d):
    return q.column_profile(ad.raw_strings(spark, d))


@query(f"SELECT column_name, CASE WHEN count(*) FILTER (NOT {_MISSING}) = 0 THEN 'empty' WHEN bool_and(regexp_matches(trim(value), '^[+-]?[0-9]+$')) FILTER (NOT {_MISSING}) THEN 'integer' WHEN bool_and(try_cast(trim(value) AS DOUBLE) IS NOT NULL OR {_INF}) FILTER (NOT {_MISSING}) THEN 'float' WHEN bool_and(lower(trim(value)) IN ('true', 'false')) FILTER (NOT {_MISSING}) THEN 'boolean' ELSE 'string' END AS inferred FROM cells GROUP BY column_name", views=_CELLS)
def infer_column_types(spark, d):
    return q.infer_types(ad.raw_strings(spark, d))


@query("SELECT (sum(n - 1))::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM raw_strings GROUP BY nationkey, mktsegment, flag)")
def duplicate_rows(spark, d):
    return q.duplicate_rows(ad.raw_strings(spark, d), ["nationkey", "mktsegment", "flag"])


@query("SELECT name, min(i) AS first_position, count(*) AS n FROM (SELECT unnest(string_split(header, ',')) AS name, unnest(range(0, 6))::INTEGER AS i FROM (SELECT 'a,b,' || n_name || ',a,b,c' AS header FROM nation)) GROUP BY name HAVING count(*) > 1")
def duplicate_column_names(spark, d):
    h = ad.table(spark, d, "nation").select(F.concat(F.lit("a,b,"), "n_name", F.lit(",a,b,c")).alias("value"))
    return q.duplicate_names(h)


@query("SELECT coalesce(k, c) AS label, coalesce(n, 0) AS n, CASE WHEN k IS NULL THEN 'UNEXPECTED' WHEN n IS NULL THEN 'ABSENT' ELSE 'EXPECTED' END AS status FROM (SELECT o_orderstatus AS c, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT unnest(['F', 'O', 'X']) AS k) ON c = k")
def class_distribution(spark, d):
    return q.class_distribution(ad.table(spark, d, "orders"), "o_orderstatus", ["F", "O", "X"])


@query("SELECT column_name, rows, missing, infinite, present, CASE WHEN contains(column_name, 'bal') THEN 'amount' WHEN contains(column_name, 'segment') OR contains(column_name, 'flag') THEN 'category' ELSE 'other' END AS feature_group, contains(column_name, 'key') AS is_identifier FROM " + f"(SELECT column_name, count(*) AS rows, count(*) FILTER ({_MISSING}) AS missing, count(*) FILTER ({_INF}) AS infinite, count(*) FILTER (NOT {_MISSING}) AS present FROM cells GROUP BY column_name)", views=_CELLS)
def classify_columns(spark, d):
    return q.classify_columns(q.column_profile(ad.raw_strings(spark, d)), {"amount": ["bal"], "category": ["segment", "flag"]}, ["key"])


@query("SELECT coalesce(e, p) AS file_name, CASE WHEN e IS NULL THEN 'UNEXPECTED' WHEN p IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS status FROM (SELECT DISTINCT source AS p FROM documents) FULL JOIN (SELECT unnest(['src0', 'src1', 'src99']) AS e) ON p = e")
def file_inventory(spark, d):
    return q.file_inventory(ad.table(spark, d, "documents"), ["src0", "src1", "src99"], "source")


@query("SELECT codes = '' AS valid, codes AS reason_codes FROM (SELECT concat_ws(',', CASE WHEN (SELECT count(*) FROM (SELECT custkey FROM raw_strings GROUP BY custkey HAVING count(*) > 1)) > 0 THEN 'DUPLICATED_KEYS' END, CASE WHEN (SELECT count(*) FROM raw_strings WHERE flag NOT IN ('True', 'false')) > 0 THEN 'UNEXPECTED_CLASS_LABELS' END) AS codes)")
def validate_tables(spark, d):
    r = ad.raw_strings(spark, d)
    return q.validate_tables([("DUPLICATED_KEYS", q.repeated_keys(r, ["custkey"])), ("UNEXPECTED_CLASS_LABELS", r.where("flag NOT IN ('True', 'false')"))])


@query("SELECT column_name, bool_and(coalesce(isfinite(try_cast(trim(value) AS DOUBLE)), false)) AS numeric FROM cells GROUP BY column_name", views=_CELLS)
def numeric_columns(spark, d):
    return q.numeric_columns(ad.raw_strings(spark, d))


_F3 = ["ch_a_mean", "ch_a_rms", "ch_b_std"]


@query("SELECT feature, count(*) AS rows, count(*) AS finite, min(x) AS lowest, max(x) AS highest, avg(x) AS mean, stddev_pop(x) AS std FROM (SELECT unnest(['ch_a_mean', 'ch_a_rms', 'ch_b_std']) AS feature, unnest([ch_a_mean, ch_a_rms, ch_b_std]) AS x FROM features) GROUP BY feature", "lowest highest mean std")
def feature_summary(spark, d):
    return q.feature_summary(ad.features(spark, d), _F3)


@query(f"SELECT row_number() OVER () AS i, custkey, nationkey, len(list_filter([acctbal, mktsegment, nothing], lambda value: coalesce(lower(trim(value)) IN ('', 'nan'), true) OR {_INF}))::DOUBLE / 3 AS missing_ratio FROM raw_strings".replace("row_number() OVER () AS i, ", ""), "missing_ratio")
def row_missing_ratio(spark, d):
    return q.row_missing_ratio(ad.raw_strings(spark, d), ["acctbal", "mktsegment", "nothing"]).select("custkey", "nationkey", "missing_ratio")


@query("SELECT acquisition_id, count(*) AS n, min(sample) = 0 AND max(sample) = count(*) - 1 AND count(DISTINCT sample) = count(*) AS contiguous, true AS all_finite, min(sample) = 0 AND max(sample) = count(*) - 1 AND count(DISTINCT sample) = count(*) AS ok FROM samples WHERE NOT (acquisition_id % 10 = 3 AND sample = 2) GROUP BY acquisition_id")
def validate_signal_index(spark, d):
    return q.validate_signal_index(ad.samples(spark, d).where("NOT (acquisition_id % 10 = 3 AND sample = 2)"))


@query("SELECT (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM customer GROUP BY c_acctbal)) AS exact_duplicates, (SELECT count(*) FROM (SELECT c_custkey AS k, c_acctbal AS a FROM customer) x JOIN (SELECT c_custkey AS k, c_acctbal AS a FROM customer) y ON x.k < y.k AND abs(x.a - y.a) <= 0.05) AS near_pairs")
def duplicate_analysis(spark, d):
    return q.duplicate_analysis(ad.table(spark, d, "customer"), "c_custkey", ["c_acctbal"], 0.05, 0.5)


_PART = "(SELECT min(p_partkey) AS k, count(*) AS n, p_retailprice AS p, p_size AS s FROM part GROUP BY ALL)"


@query(f"SELECT x.k AS a, y.k AS b, CASE WHEN x.k = y.k THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END::BIGINT AS pairs FROM {_PART} x JOIN {_PART} y ON (x.k < y.k OR x.k = y.k AND x.n > 1) AND abs(x.p - y.p) <= 0.5 AND abs(x.s - y.s) <= 0.5")
def near_duplicate_pairs(spark, d):
    return q.near_duplicate_pairs(ad.table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], 0.5, 1.0)


@query("SELECT 'classes' AS \"check\", (SELECT count(DISTINCT canonical_class) FROM acquisitions) AS observed, 4::BIGINT AS expected, (SELECT count(DISTINCT canonical_class) FROM acquisitions) = 4 AS ok UNION ALL SELECT 'repeated windows', (SELECT count(*) FROM (SELECT 1 FROM features GROUP BY acquisition_id, window_order HAVING count(*) > 1)), 0, true UNION ALL SELECT 'regions', (SELECT count(*) FROM region), 7, false")
def prerequisite_audit(spark, d):
    a, f = ad.acquisitions(spark, d), ad.features(spark, d)
    return q.audit_checks([("classes", a.agg(F.count_distinct("canonical_class")), len(CLASSES)), ("repeated windows", q.repeated_keys(f, ["acquisition_id", "window_order"]).agg(F.count("*")), 0), ("regions", ad.table(spark, d, "region").agg(F.count("*")), 7)])


@query("SELECT custkey, count(*) AS n FROM raw_strings GROUP BY custkey HAVING count(*) > 1")
def unique_key_check(spark, d):
    return q.repeated_keys(ad.raw_strings(spark, d), ["custkey"])


@query(r"""SELECT event_id, event_id % 3 = 0 AS leaks FROM events""")
def label_leak_guard(spark, d):
    """A third of the events has a nested label; another third a text that looks like one."""
    k = F.col("event_id") % 3
    nested = F.concat(F.lit('[1, {"a": {"true\\u005flabel" : '), "props", F.lit("}}]"))
    e = ad.table(spark, d, "events").select("event_id", F.when(k == 0, nested).when(k == 1, r'{"note": "\"label\": 1", "x": "label"}').otherwise(F.col("props")).alias("payload"))
    return q.label_leaks(q.reject_label_columns(e), "payload").select("event_id", "leaks")


@query("SELECT view_id, acquisition_id, window_order, CASE WHEN window_order = 1 THEN 'PROBABILITY_SUM' WHEN window_order = 2 THEN 'PREDICTION_NOT_ARGMAX' WHEN window_order = 3 THEN 'CONFIDENCE_MISMATCH' END AS rejection_code FROM predictions")
def contract_filter(spark, d):
    p = ad.predictions(spark, d)
    w = F.col("window_order")
    p = p.withColumn("p", F.when(w == 1, F.transform("p", lambda x: x / 2)).otherwise(F.col("p"))).withColumn("predicted_class", F.when(w == 2, "none").otherwise(F.col("predicted_class"))).withColumn("confidence", F.when(w == 3, F.col("confidence") / 2).otherwise(F.col("confidence")))
    return q.window_contract(p, CLASSES).select("view_id", "acquisition_id", "window_order", "rejection_code")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'SCHEMA_VERSION' WHEN o_orderkey % 6 = 1 THEN 'CREATOR_MISSING' WHEN o_orderkey % 6 = 2 THEN 'TIME_INVALID' WHEN o_orderkey % 6 = 3 THEN 'INPUT_HASH_FORMAT' WHEN o_orderkey % 6 = 4 THEN 'PARTITION_UNKNOWN' END AS rejection_code FROM orders")
def provenance_contract(spark, d):
    k = F.col("o_orderkey") % 6
    o = ad.table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "0").otherwise("1.0").alias("schema_version"), F.when(k == 1, " ").otherwise("me").alias("creator"), F.when(k == 2, "yesterday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("created_at"), F.array(F.when(k == 3, "abc").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256))).alias("input_hashes"), F.when(k == 4, "elsewhere").otherwise("train").alias("partition"))
    return q.provenance_contract(o, "1.0").select("o_orderkey", "rejection_code")


@query("SELECT count(*) AS rows, 6 AS columns, count(DISTINCT flag) AS classes, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM raw_strings GROUP BY nationkey, acctbal, mktsegment, flag, nothing)) AS duplicate_rows, (SELECT count(*) FROM (SELECT 1 FROM raw_strings GROUP BY custkey HAVING count(*) > 1)) AS repeated_ids FROM raw_strings")
def dataset_audit(spark, d):
    return q.dataset_audit(ad.raw_strings(spark, d), "flag", "custkey")
