"""Risk, safety, bundles and case selection (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import content_hash, fixed, saturate as saturated
from ..operators import aggregate as ag, deviation as de, ml, reference as rf, risk as rk, trends as tr
from ..plans import adapters as ad
from ..plans.storage import stored
from ..schemas import BASELINE, CLASSES
from ._registry import query
from .aggregates import _DEV, _ENT, _EVIDENCE, _REF, _rows, _scored
from .trending import _views

KEYS = ["view_id", "acquisition_id"]
BUNDLE = [*KEYS, "trend_model"]

_W = rk.WEIGHTS


def _fx(c: str) -> str:
    return f"round({c}, 6)::DECIMAL(38,6)::VARCHAR"


_K = (
    _EVIDENCE
    | _DEV
    | {k: v for k, v in _REF.items() if k in ("refs", "healthy")}
    | _views(0.0)
    | {
        "acq": f"SELECT view_id, acquisition_id, {ad._CLASS_LIST}[list_position(list_transform([p0, p1, p2, p3], lambda x: round(x, 12)), round(greatest(p0, p1, p2, p3), 12))] AS predicted_class, greatest(p0, p1, p2, p3) AS confidence, {_ENT} AS entropy FROM mean_p",
        "wins": "SELECT view_id, acquisition_id, window_order, predicted_class, p.confidence, deviation FROM predictions p JOIN scored USING (view_id, acquisition_id, window_order)",
        "dist": "SELECT view_id, acquisition_id, avg(healthy_distance) AS healthy_distance FROM healthy GROUP BY ALL",
        "trend": "SELECT acquisition_id, m AS trend_model, uncertainty * f AS uncertainty FROM evidence, (VALUES ('bspline', 0.02), ('half', 0.01)) t(m, f)",
        "comps": f"""SELECT view_id, acquisition_id, trend_model, predicted_class, confidence, entropy AS classifier_uncertainty, least(1.0, uncertainty) AS trend_uncertainty, ood_contribution, least(1.0, healthy_distance / 3) AS healthy_deviation,
(least(1.0, healthy_distance / 3) >= 0.5) <> (predicted_class <> '{BASELINE}') AS conflict, k > 1 AS unstable FROM acq JOIN dist USING (view_id, acquisition_id) JOIN (SELECT view_id, acquisition_id, max(deviation) AS ood_contribution, count(DISTINCT predicted_class) AS k FROM wins GROUP BY ALL) USING (view_id, acquisition_id) JOIN trend USING (acquisition_id)""",
        "risks": f"SELECT *, {_W['classifier_uncertainty']}::DOUBLE * classifier_uncertainty + {_W['trend_uncertainty']}::DOUBLE * trend_uncertainty + {_W['ood_contribution']}::DOUBLE * ood_contribution + {_W['healthy_deviation']}::DOUBLE * healthy_deviation + CASE WHEN conflict OR unstable THEN {_W['instability']}::DOUBLE ELSE 0 END AS combined_risk FROM comps",
        "wtext": f"SELECT view_id, acquisition_id, string_agg(sha256(window_order || '|' || predicted_class || '|' || {_fx('round(confidence, 6)')}), ';' ORDER BY window_order) AS t, count(*) AS n FROM wins GROUP BY ALL",
        "refhash": f"SELECT view_id, sha256({_fx('m1')} || '|' || {_fx('s1')} || '|' || {_fx('m2')} || '|' || {_fx('s2')}) AS healthy_reference_hash FROM refs",
        "bundles": f"""SELECT view_id, acquisition_id, trend_model, n, predicted_class, combined_risk, healthy_reference_hash, sha256('1.0|' || view_id || '|' || acquisition_id || '|' || trend_model || '|time_features|centroid|' || healthy_reference_hash) AS metadata_hash,
t || ';' || sha256(predicted_class || '|' || {_fx('confidence')} || '|' || {_fx('classifier_uncertainty')}) || ';' || sha256('FIT_OK|' || {_fx('uncertainty')}) || ';' || sha256({_fx('combined_risk')} || '|' || {_fx('classifier_uncertainty')} || '|' || {_fx('trend_uncertainty')} || '|' || {_fx('ood_contribution')} || '|' || {_fx('healthy_deviation')} || '|' || conflict || '|' || unstable) || ';' || sha256({_fx('combined_risk')} || '|' || {_fx('confidence')} || '|' || {_fx('ood_contribution')} || '|' || conflict) AS input_hashes
FROM risks JOIN wtext USING (view_id, acquisition_id) JOIN refhash USING (view_id) JOIN trend USING (acquisition_id, trend_model)""",
        "cases": "SELECT *, view_id || '-' || acquisition_id || '-' || trend_model AS case_id, round(combined_risk, 9) AS r FROM risks",
    }
)


def _evidence(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(acquisitions with their distance, trends, windows with deviation)."""
    f = stored(ad.labelled_features(spark, d).select("acquisition_id", "window_order", "canonical_class", "run_rank", "ch_a_mean", "ch_b_mean"), "features")
    p = stored(ad.predictions(spark, d, f), "predictions")
    r = _rows(spark, d, f)
    windows = stored(p.join(_scored(spark, d, r).select("view_id", "acquisition_id", "window_order", "deviation"), ["view_id", "acquisition_id", "window_order"]), "windows")
    reference = rf.fit_reference(r, ["view_id"], BASELINE)
    told = reference.select("view_id", content_hash(*[fixed(F.col(c)[k]) for k in (0, 1) for c in ("mean", "scale")]).alias("healthy_reference_hash"))
    dist = rf.reference_distance(r, reference, ["view_id"]).groupBy(*KEYS).agg(F.avg("healthy_distance").alias("healthy_distance")).join(told, "view_id", "left")
    acq = stored(ag.aggregate_evidence(p, KEYS, CLASSES).join(dist, KEYS), "acquisitions")
    s = f.select("acquisition_id", "window_order", F.col("ch_a_mean").alias("y"))
    trends = tr.with_status(s, tr.descriptors(tr.linear_fit(s)))
    model = F.explode(F.array(F.struct(F.lit("bspline").alias("trend_model"), F.lit(0.02).alias("f")), F.struct(F.lit("half").alias("trend_model"), F.lit(0.01).alias("f"))))
    trends = trends.select("acquisition_id", "fit_status", "uncertainty", model.alias("m")).select("acquisition_id", "fit_status", "m.trend_model", (F.col("uncertainty") * F.col("m.f")).alias("uncertainty"))
    return acq, stored(trends, "trends"), windows


def _risk(spark, d, evidence=None) -> tuple[DataFrame, DataFrame]:
    acq, trends, windows = evidence or _evidence(spark, d)
    return rk.combined_risk(rk.risk_components(acq, trends, windows, KEYS, BASELINE)), windows


def _bundles(spark, d, evidence=None) -> DataFrame:
    acq, trends, windows = evidence or _evidence(spark, d)
    risk = rk.combined_risk(rk.risk_components(acq, trends, windows, KEYS, BASELINE))
    acq = acq.withColumn("representation_id", F.lit("time_features")).withColumn("classifier_id", F.lit("centroid"))
    return rk.bundle_hash(rk.build_bundles(windows, acq, trends.where("fit_status = 'FIT_OK'"), risk, KEYS, metadata=["representation_id", "classifier_id", "healthy_reference_hash"]))


def _cases(spark, d, evidence=None) -> DataFrame:
    risk, _ = _risk(spark, d, evidence)
    return risk.withColumn("case_id", F.concat_ws("-", *[F.col(k).cast("string") for k in BUNDLE])).withColumn("combined_risk", F.round("combined_risk", 9))


@query("SELECT o_orderkey, least(1.0, abs(o_totalprice - 250000) / 60013) AS saturated FROM orders", "saturated")
def saturate(spark, d):
    return ad.table(spark, d, "orders").select("o_orderkey", saturated(F.col("o_totalprice") - 250000, 60013.0).alias("saturated"))


@query("SELECT * FROM comps", "confidence classifier_uncertainty trend_uncertainty ood_contribution healthy_deviation", _K)
def risk_components(spark, d):
    acq, trends, windows = _evidence(spark, d)
    return rk.risk_components(acq, trends, windows, KEYS, BASELINE)


@query("SELECT view_id, acquisition_id, trend_model, combined_risk FROM risks", "combined_risk", _K)
def combined_risk(spark, d):
    return _risk(spark, d)[0].select(*BUNDLE, "combined_risk")


_GUARDS = ("TREND_MISSING", "TREND_NOT_USABLE", "ASSIGNMENT_MISMATCH", "PARTITION_MISMATCH", "MODEL_HASH_MISMATCH", "UNKNOWN_HEALTHY_REFERENCE")


@query(f"SELECT view_id, acquisition_id, 'EVIDENCE_' || {list(_GUARDS)}[acquisition_id % 8 + 1] AS code FROM acq WHERE acquisition_id % 8 < 6", views=_K)
def join_guards(spark, d):
    """Six of eight acquisitions have a trend that doesn't fit them."""
    k = F.col("acquisition_id") % 8
    p = ad.predictions(spark, d).select(*KEYS, "split_role").distinct().select(*KEYS, F.col("view_id").cast("string").alias("assignment_id"), F.col("split_role").alias("partition"), F.sha2(F.col("view_id").cast("string"), 256).alias("model_hash"))
    t = p.where(k != 0).withColumn("fit_status", F.when(k == 1, "FIT_FAILED").otherwise("FIT_OK")).withColumn("healthy_distance", F.lit(1.0)).withColumn("healthy_reference_hash", F.when(k != 5, F.sha2("assignment_id", 256)))
    changed = {c: F.when(k == n, F.concat(c, F.lit("x"))).otherwise(F.col(c)) for n, c in ((2, "assignment_id"), (3, "partition"), (4, "model_hash"))}
    return rk.join_guard(p, t.withColumns(changed), KEYS)


@query("SELECT view_id, acquisition_id, trend_model, combined_risk AS risk_score, confidence, ood_contribution AS ood_score, conflict AS spline_classifier_conflict FROM risks", "risk_score confidence ood_score", _K)
def safety_projection(spark, d):
    return rk.safety_projection(_risk(spark, d)[0], BUNDLE)


@query("SELECT view_id, acquisition_id, trend_model, n::INTEGER AS windows, predicted_class, 'FIT_OK' AS fit_status, combined_risk AS risk_score, healthy_reference_hash FROM bundles", "risk_score", _K)
def build_bundles(spark, d):
    return _bundles(spark, d).select(*BUNDLE, F.size("windows").alias("windows"), "acquisition.predicted_class", "trend.fit_status", "safety.risk_score", "metadata.healthy_reference_hash")


@query("SELECT view_id, acquisition_id, trend_model, input_hashes, sha256(metadata_hash || '|' || input_hashes) AS bundle_hash FROM bundles", views=_K)
def bundle_hash(spark, d):
    return _bundles(spark, d).select(*BUNDLE, F.array_join("input_hashes", ";").alias("input_hashes"), "bundle_hash")


@query("SELECT view_id, acquisition_id, CASE WHEN acquisition_id % 8 = 5 THEN 'other' ELSE trend_model END AS trend_model, CASE acquisition_id % 8 WHEN 0 THEN 'EVIDENCE_INPUT_HASH_MISMATCH' WHEN 1 THEN 'EVIDENCE_BUNDLE_HASH_MISMATCH' WHEN 2 THEN 'EVIDENCE_TREND_MISSING' WHEN 3 THEN 'EVIDENCE_MISSING_FIELD' WHEN 4 THEN 'EVIDENCE_SCHEMA_VERSION_MISMATCH' WHEN 5 THEN 'EVIDENCE_PARQUET_METADATA_MISMATCH' WHEN 6 THEN 'EVIDENCE_INPUT_HASH_MISMATCH' ELSE 'VALID' END AS code FROM bundles", views=_K)
def verify_bundles(spark, d):
    """Seven of eight acquisitions have bundles with something altered."""
    k = F.col("acquisition_id") % 8
    changed = {
        "risk": F.when(k == 0, F.col("risk").withField("combined_risk", F.lit(9.0))).otherwise(F.col("risk")),
        "bundle_hash": F.when(k == 1, "y").otherwise(F.col("bundle_hash")),
        "trend": F.when(k != 2, F.col("trend")),
        "safety": F.when(k != 3, F.col("safety")),
        "metadata": F.when(k == 4, F.col("metadata").withField("schema_version", F.lit("0"))).otherwise(F.col("metadata")),
        "trend_model": F.when(k == 5, "other").otherwise(F.col("trend_model")),
        "windows": F.when(k == 6, F.slice("windows", 2, 1000)).otherwise(F.col("windows")),
    }
    return rk.verify_bundles(stored(_bundles(spark, d), "bundles").withColumns(changed), BUNDLE)


@query("SELECT p_partkey, trim(regexp_replace('.' || p_name || '!', '[^A-Za-z0-9_.-]+', '-', 'g'), '-.') || '__' || trim(regexp_replace(p_brand, '[^A-Za-z0-9_.-]+', '-', 'g'), '-.') AS name FROM part")
def bundle_name(spark, d):
    return ad.table(spark, d, "part").select("p_partkey", rk.safe_name(F.concat(F.lit("."), "p_name", F.lit("!")), F.col("p_brand")).alias("name"))


@query("SELECT view_id, acquisition_id, trend_model, i::INTEGER AS position, CASE WHEN i <= n THEN 'window' ELSE ['acquisition', 'trend', 'risk', 'safety'][i - n] END AS kind, string_split(input_hashes, ';')[i] AS evidence_hash FROM (SELECT *, unnest(range(1, n + 5)) AS i FROM bundles)", views=_K)
def expand_evidence(spark, d):
    return rk.expand_evidence(_bundles(spark, d), BUNDLE)


_SEL = f"SELECT rule, case_id, r AS combined_risk, CASE WHEN case_id IS NULL THEN 'EMPTY' ELSE 'SELECTED' END AS status FROM (VALUES ('baseline'), ('high_risk'), ('conflict')) t(rule) LEFT JOIN (FROM (SELECT 'baseline' AS rule, case_id, r FROM cases WHERE predicted_class = '{BASELINE}' ORDER BY r, case_id LIMIT 1) UNION ALL FROM (SELECT 'high_risk', case_id, r FROM cases WHERE predicted_class <> '{BASELINE}' ORDER BY r DESC, case_id LIMIT 1) UNION ALL FROM (SELECT 'conflict', case_id, r FROM cases WHERE conflict ORDER BY NOT unstable, r DESC, case_id LIMIT 1)) USING (rule)"


@query(_SEL, "combined_risk", _K)
def select_cases(spark, d):
    return rk.select_cases(stored(_cases(spark, d), "cases"), BASELINE)


@query(f"SELECT DISTINCT case_id, 1::BIGINT AS bundles, true AS ok FROM ({_SEL}) WHERE status = 'SELECTED'", views=_K)
def resolve_cases(spark, d):
    evidence = _evidence(spark, d)
    b = _bundles(spark, d, evidence).withColumn("case_id", F.concat_ws("-", *[F.col(k).cast("string") for k in BUNDLE]))
    cases = stored(rk.select_cases(stored(_cases(spark, d, evidence), "cases"), BASELINE), "selected")  # three rows
    return rk.resolve_cases(cases, b)


@query("SELECT 'windows' AS \"table\", (SELECT count(*) FROM wins) AS records UNION ALL SELECT 'risk', (SELECT count(*) FROM risks)", views=_K)
def evidence_summary(spark, d):
    risk, windows = _risk(spark, d)
    return rk.record_counts({"windows": windows, "risk": risk})


@query("SELECT split_role, count(*) AS joined FROM predictions JOIN (SELECT view_id, acquisition_id, window_order FROM scored WHERE split_role <> 'train') USING (view_id, acquisition_id, window_order) GROUP BY split_role UNION ALL SELECT 'unmatched', count(*) FROM predictions WHERE split_role = 'train'", views=_K)
def attach_scores(spark, d):
    """The counts are those of the assembled windows, by the partition in their provenance, and of what has no score."""
    at = [*KEYS, "window_order"]
    f = stored(ad.labelled_features(spark, d).select("acquisition_id", "window_order", "canonical_class", "run_rank", "ch_a_mean", "ch_b_mean"), "features")
    own = {"assignment_id": F.col("view_id").cast("string"), "representation_id": F.lit("time_features"), "classifier_id": F.lit("centroid")}
    p = ml.prediction_hash(ad.predictions(spark, d, f), at).withColumn("provenance", F.create_map(*[c for k, v in own.items() for c in (F.lit(k), v)]))
    p, r = stored(p, "predictions"), _rows(spark, d, f)
    scorer = stored(de.invert_precision(de.fit_covariance(r, ["view_id"]), ["view_id"]), "scorer")
    text = lambda c: F.array_join(F.transform(c, lambda v: fixed(v)), ",")
    hashed = scorer.select("view_id", content_hash("view_id", text("mean"), text("scale"), text(F.flatten("precision"))).alias("scorer_hash"))
    inputs, lost = rk.attach_scores(p, de.score_records(_scored(spark, d, r, scorer), at).join(hashed, "view_id"), at, CLASSES)
    windows = stored(inputs, "inputs").select(F.explode("windows").alias("w"))
    joined = windows.groupBy(F.col("w.provenance")["source_partition"].alias("split_role")).agg(F.count("*").alias("joined"))
    return joined.union(lost.agg(F.count("*").alias("joined")).select(F.lit("unmatched"), "joined"))


