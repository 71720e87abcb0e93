"""Risk and safety evidence, bundles and case selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import content_hash, first_reason, fixed, saturate

# The weights of the combined risk, which sum to 1, and the saturation scales.
WEIGHTS = {"classifier_uncertainty": 0.25, "trend_uncertainty": 0.20, "ood_contribution": 0.20, "healthy_deviation": 0.20, "instability": 0.15}
TREND_SCALE, DEVIATION_SCALE, CONFLICT_AT = 1.0, 3.0, 0.5


def risk_components(acquisitions: DataFrame, trends: DataFrame, windows: DataFrame, keys: Sequence[str], baseline: str) -> DataFrame:
    """(keys, trend_model, components, conflict, unstable) of acquisitions joined to each fitted trend of theirs.

    Components: entropy; saturated trend uncertainty; largest window deviation; saturated distance from the reference.
    Conflict: exactly one of deviation >= 0.5 and a class other than the baseline. Unstable: windows predict several classes.
    """
    w = windows.groupBy(*keys).agg(F.max("deviation").alias("ood_contribution"), F.count_distinct("predicted_class").alias("_k"))
    j = acquisitions.join(w, list(keys)).join(trends.where("fit_status = 'FIT_OK'"), [k for k in keys if k in trends.columns])
    deviation = saturate("healthy_distance", DEVIATION_SCALE)
    return j.select(
        *keys,
        "trend_model",
        "predicted_class",
        F.col("confidence"),
        F.col("entropy").alias("classifier_uncertainty"),
        saturate("uncertainty", TREND_SCALE).alias("trend_uncertainty"),
        "ood_contribution",
        deviation.alias("healthy_deviation"),
        ((deviation >= CONFLICT_AT) != (F.col("predicted_class") != baseline)).alias("conflict"),
        (F.col("_k") > 1).alias("unstable"),
    )


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-12:
        raise ValueError("weights are at least 0 and sum to 1")
    return weights


def combined_risk(components: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    w = check_weights(weights)
    parts = sum((F.lit(v) * F.col(k) for k, v in w.items() if k != "instability"), F.lit(0.0))
    return components.withColumn("combined_risk", parts + F.when(F.col("conflict") | F.col("unstable"), F.lit(w["instability"])).otherwise(0.0))


def join_guard(acquisitions: DataFrame, trends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, code) of each pair of an acquisition and a trend of its that doesn't join, the first reason of it; acquisitions
    without any trend are EVIDENCE_TREND_MISSING.

    Both tables have assignment_id, partition and model_hash; trends have fit_status, healthy_distance and
    healthy_reference_hash. A null agrees with a null alone.
    """
    same = ("assignment_id", "partition", "model_hash")
    left = acquisitions.select(*keys, *[F.col(c).alias(f"_{c}") for c in same])
    right = trends.select(*keys, *same, "fit_status", "healthy_distance", "healthy_reference_hash", F.lit(True).alias("_found"))
    j = left.join(right, list(keys), "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    code = first_reason(
        (F.col("_found").isNull(), "EVIDENCE_TREND_MISSING"),
        (~F.col("fit_status").eqNullSafe(F.lit("FIT_OK")), "EVIDENCE_TREND_NOT_USABLE"),
        (differs("assignment_id"), "EVIDENCE_ASSIGNMENT_MISMATCH"),
        (differs("partition"), "EVIDENCE_PARTITION_MISMATCH"),
        (differs("model_hash"), "EVIDENCE_MODEL_HASH_MISMATCH"),
        (F.col("healthy_distance").isNotNull() & F.col("healthy_reference_hash").isNull(), "EVIDENCE_UNKNOWN_HEALTHY_REFERENCE"),
    )
    return j.select(*keys, code.alias("code")).where("code IS NOT NULL")


def _safety() -> list:
    return [F.col("combined_risk").alias("risk_score"), F.col("confidence"), F.col("ood_contribution").alias("ood_score"), F.col("conflict").alias("spline_classifier_conflict")]


def safety_projection(risk: DataFrame, keys: Sequence[str]) -> DataFrame:
    return risk.select(*keys, *_safety())


#: The version of the bundles' layout, and the parts besides the windows, in the order of their hashes.
BUNDLE_VERSION = "1.0"
PARTS = ("acquisition", "trend", "risk", "safety")


def build_bundles(windows: DataFrame, acquisitions: DataFrame, trends: DataFrame, risk: DataFrame, keys: Sequence[str], trend_keys: Sequence[str] = ("trend_model",), metadata: Sequence[str] = ()) -> DataFrame:
    """(keys, trend_keys, metadata, windows, acquisition, trend, risk, safety): the evidence of an acquisition and one trend.

    `metadata` are columns of the acquisitions that the metadata hold beside version and keys. Windows are an array in order:
    an acquisition has a bounded number of them; they are gathered once and joined to its bundles.
    """
    at = [*keys, *trend_keys]
    item = F.struct("window_order", "predicted_class", F.round("confidence", 6).alias("confidence"))
    w = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("windows"))
    a = acquisitions.select(*keys, *[F.col(c).alias(f"_{c}") for c in metadata], F.struct("predicted_class", "confidence", "entropy").alias("acquisition"))
    own = [k for k in at if k in trends.columns]
    t = trends.select(*own, F.struct("fit_status", "uncertainty").alias("trend"))
    parts = F.struct("combined_risk", "classifier_uncertainty", "trend_uncertainty", "ood_contribution", "healthy_deviation", "conflict", "unstable").alias("risk")
    r = risk.select(*at, parts, F.struct(*_safety()).alias("safety"))
    j = r.join(t, own).join(a, list(keys)).join(w, list(keys))
    about = F.struct(F.lit(BUNDLE_VERSION).alias("schema_version"), *at, *[F.col(f"_{c}").alias(c) for c in metadata])
    return j.select(*at, about.alias("metadata"), "windows", *PARTS)


def _digest(bundles: DataFrame, part: str):
    """The hash of a struct's fields, doubles with six places."""
    return content_hash(*[fixed(f"{part}.{f.name}") if f.dataType.simpleString() == "double" else F.col(f"{part}.{f.name}") for f in bundles.schema[part].dataType.fields])


def _hashes(bundles: DataFrame) -> tuple:
    """(input hashes: each window's, then those of the parts; bundle hash: of the metadata and them)."""
    window = F.transform("windows", lambda x: content_hash(x["window_order"], x["predicted_class"], fixed(x["confidence"])))
    inputs = F.concat(window, F.array(*[_digest(bundles, p) for p in PARTS]))
    return inputs, content_hash(_digest(bundles, "metadata"), F.array_join(inputs, ";"))


def bundle_hash(bundles: DataFrame) -> DataFrame:
    """Bundles with input_hashes, an array, and bundle_hash."""
    inputs, whole = _hashes(bundles)
    return bundles.withColumn("input_hashes", inputs).withColumn("bundle_hash", whole)


def verify_bundles(bundles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, code): VALID, or the first fault of a stored bundle, all within its row.

    A part that is absent, another version, input hashes and a bundle hash that are others when made again, and keys beside
    the bundle that differ from its metadata.
    """
    inputs, whole = _hashes(bundles)
    absent = F.coalesce(F.size("windows"), F.lit(0)) < 1
    for c in ("metadata", *[p for p in PARTS if p != "trend"], "input_hashes", "bundle_hash"):
        absent = absent | F.col(c).isNull()
    apart = F.lit(False)
    for k in keys:
        apart = apart | ~F.col(k).eqNullSafe(F.col(f"metadata.{k}"))
    code = first_reason(
        (F.col("trend").isNull(), "EVIDENCE_TREND_MISSING"),
        (absent, "EVIDENCE_MISSING_FIELD"),
        (~F.col("metadata.schema_version").eqNullSafe(F.lit(BUNDLE_VERSION)), "EVIDENCE_SCHEMA_VERSION_MISMATCH"),
        (F.col("input_hashes") != inputs, "EVIDENCE_INPUT_HASH_MISMATCH"),
        (F.col("bundle_hash") != whole, "EVIDENCE_BUNDLE_HASH_MISMATCH"),
        (apart, "EVIDENCE_PARQUET_METADATA_MISMATCH"),
        ok="VALID",
    )
    return bundles.select(*keys, code.alias("code"))


def expand_evidence(bundles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, position, kind, evidence_hash): a row for each piece of evidence in a bundle, the windows first."""
    b = bundles.select(*keys, F.size("windows").alias("_n"), F.posexplode("input_hashes").alias("position", "evidence_hash"))
    part = F.element_at(F.array(*[F.lit(p) for p in PARTS]), F.greatest(F.col("position") - F.col("_n"), F.lit(0)) + 1)
    return b.select(*keys, (F.col("position") + 1).alias("position"), F.when(F.col("position") < F.col("_n"), "window").otherwise(part).alias("kind"), "evidence_hash")


def safe_name(*parts):
    """Parts joined by `__`; other characters than letters, digits, `_`, `.` and `-` become `-`, outer `-` and `.` go."""
    clean = [F.btrim(F.regexp_replace(p, r"[^A-Za-z0-9_.-]+", "-"), F.lit("-.")) for p in parts]
    return F.concat_ws("__", *clean)


def select_cases(risk: DataFrame, baseline: str, key: str = "case_id") -> DataFrame:
    """(rule, key, combined_risk, status): the calmest baseline case, the riskiest other one, and a conflict case, or EMPTY.

    Ties go by id. Each rule is a top-1, which combines before its shuffle.
    """
    spark = risk.sparkSession
    rules = spark.createDataFrame([("baseline",), ("high_risk",), ("conflict",)], "rule string")
    r = risk.select(key, "combined_risk", "predicted_class", "conflict", "unstable")
    pick = lambda name, cond, order: r.where(cond).agg(F.min(order).alias("o")).select(F.lit(name).alias("rule"), F.col(f"o.{key}").alias(key), F.abs("o.r").alias("combined_risk"))
    found = pick("baseline", F.col("predicted_class") == baseline, F.struct(F.col("combined_risk").alias("r"), key))
    found = found.unionByName(pick("high_risk", F.col("predicted_class") != baseline, F.struct((-F.col("combined_risk")).alias("r"), key)))
    found = found.unionByName(pick("conflict", "conflict", F.struct((~F.col("unstable")).alias("u"), (-F.col("combined_risk")).alias("r"), key)))
    j = rules.join(found, "rule", "left")
    return j.withColumn("status", F.when(F.col(key).isNull(), "EMPTY").otherwise("SELECTED"))


def resolve_cases(cases: DataFrame, bundles: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, bundles, ok): each selected case has exactly one bundle, by hash."""
    n = bundles.join(cases.where("status = 'SELECTED'").select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count_distinct("bundle_hash").alias("bundles"))
    return n.withColumn("ok", F.col("bundles") == 1)


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, records)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("records")).select(F.lit(name).alias("table"), "records")
        out = one if out is None else out.unionAll(one)
    return out


#: What the provenance of every scored window says beside its hashes.
SCORE_PROVENANCE = {"deviation_method_id": "TRAINING_DISTRIBUTION_DEVIATION_V1", "deviation_scientific_status": "OOD_SURROGATE_NOT_EXTERNALLY_VALIDATED", "r3_partition": "test"}


def attach_scores(predictions: DataFrame, scores: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs, predictions without a score); the last of `keys` orders an acquisition's windows.

    Inputs are (other keys, class_order, windows), a row an acquisition: its scored windows in order, each with predicted
    class, probabilities in the order of `classes`, ood_score, prediction_hash and provenance. Provenance is a map sorted by
    key: the prediction's own (a map of strings; null is empty) and the hashes of prediction, score and scorer, the partition
    and SCORE_PROVENANCE, which replace entries of the same name.
    """
    *by, order = keys
    own = F.map_entries(F.coalesce("provenance", F.create_map().cast("map<string,string>")))
    item = F.struct(order, "predicted_class", F.col("p").alias("probabilities"), F.col("deviation").alias("ood_score"), "prediction_hash", "score_hash", "scorer_hash", "split_role", own.alias("own"))

    def told(w):
        more = {"prediction_hash": w["prediction_hash"], "deviation_score_hash": w["score_hash"], "deviation_scorer_hash": w["scorer_hash"], "source_partition": w["split_role"]}
        more |= {k: F.lit(v) for k, v in SCORE_PROVENANCE.items()}
        entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in more.items()])
        provenance = F.map_from_entries(F.array_sort(F.concat(F.filter(w["own"], lambda e: ~e["key"].isin(*more)), entries)))
        return F.struct(*[w[c].alias(c) for c in (order, "predicted_class", "probabilities", "ood_score", "prediction_hash")], provenance.alias("provenance"))

    gathered = predictions.join(scores, list(keys)).groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_w"))
    inputs = gathered.select(*by, F.array(*[F.lit(c) for c in classes]).alias("class_order"), F.transform("_w", told).alias("windows"))
    return inputs, predictions.join(scores, list(keys), "left_anti")

