"""From windows to acquisitions (G), deviation (H) and healthy reference (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as ag, deviation as de, reference as rf
from ..plans import adapters as ad
from ..plans.storage import stored
from ..schemas import BASELINE, CLASSES
from ._registry import query

KEYS = ["view_id", "acquisition_id"]
_P = " ".join(f"p{k}" for k in range(4))


def _spread(df):
    """The probabilities of an array as columns p0 .. p3."""
    return df.select(*[c for c in df.columns if c != "p"], *[F.col("p")[k].alias(f"p{k}") for k in range(4)])


def _agg_sql(makes: list[str], extra: str = "") -> str:
    names = ", ".join(f"{m} AS q{k}" for k, m in enumerate(makes))
    total = " + ".join(f"q{k}" for k in range(4))
    return f"SELECT view_id, acquisition_id, {', '.join(f'q{k} / ({total}) AS p{k}' for k in range(4))}{extra} FROM (SELECT view_id, acquisition_id, {names} FROM predictions GROUP BY ALL)"


@query(_agg_sql([f"avg(p[{k + 1}])" for k in range(4)]), _P)
def mean_probability(spark, d):
    return _spread(ag.aggregate_probability(ad.predictions(spark, d), KEYS, CLASSES))


@query(_agg_sql([f"median(p[{k + 1}])" for k in range(4)]), _P)
def median_probability(spark, d):
    return _spread(ag.aggregate_probability(ad.predictions(spark, d), KEYS, CLASSES, "median"))


@query(_agg_sql([f"avg((predicted_class = '{c}')::INTEGER)" for c in CLASSES]), _P)
def majority_vote(spark, d):
    return _spread(ag.aggregate_probability(ad.predictions(spark, d), KEYS, CLASSES, "majority"))


@query(_agg_sql([f"sum(confidence * p[{k + 1}]) / sum(confidence)" for k in range(4)]), _P)
def confidence_weighted(spark, d):
    return _spread(ag.aggregate_probability(ad.predictions(spark, d), KEYS, CLASSES, "confidence"))


@query("SELECT view_id, acquisition_id, window_order, entropy FROM predictions", "entropy")
def normalized_entropy(spark, d):
    return ad.predictions(spark, d).select("view_id", "acquisition_id", "window_order", "entropy")


@query("SELECT view_id, acquisition_id, count(*) AS window_count, string_agg(window_order::VARCHAR, ',' ORDER BY window_order) AS windows FROM predictions GROUP BY ALL")
def window_lists(spark, d):
    return ag.window_lists(ad.predictions(spark, d), KEYS)


_ENT = "-(" + " + ".join(f"CASE WHEN p{k} > 0 THEN p{k} * ln(p{k}) ELSE 0 END" for k in range(4)) + ") / ln(4)"
_EVIDENCE = {"mean_p": _agg_sql([f"avg(p[{k + 1}])" for k in range(4)])}


@query(f"SELECT view_id, acquisition_id, valid_windows, 0::BIGINT AS invalid_windows, {ad._CLASS_LIST}[list_position(list_transform([p0, p1, p2, p3], lambda x: round(x, 12)), round(greatest(p0, p1, p2, p3), 12))] AS predicted_class, greatest(p0, p1, p2, p3) AS confidence, {_ENT} AS entropy FROM mean_p JOIN (SELECT view_id, acquisition_id, count(*) AS valid_windows FROM predictions GROUP BY ALL) USING (view_id, acquisition_id)", "confidence entropy", _EVIDENCE)
def aggregate_evidence(spark, d):
    return ag.aggregate_evidence(ad.predictions(spark, d), KEYS, CLASSES).drop("p")


@query("SELECT acquisition_id, CASE WHEN count(DISTINCT split_role) > 1 THEN 'MIXED_SPLIT_ROLE' WHEN count(*) <> count(DISTINCT window_order) THEN 'DUPLICATED_WINDOW' END AS code FROM predictions WHERE view_id = 0 OR acquisition_id % 2 = 0 GROUP BY acquisition_id")
def homogeneity_check(spark, d):
    return ag.homogeneity_check(ad.predictions(spark, d).where("view_id = 0 OR acquisition_id % 2 = 0"), ["acquisition_id"], ["split_role"])


@query("SELECT view_id, acquisition_id, true AS equivalent FROM mean_p", views=_EVIDENCE)
def aggregation_equivalence(spark, d):
    p = ad.predictions(spark, d)
    a = ag.aggregate_evidence(p, KEYS, CLASSES)
    b = ag.aggregate_evidence(p.repartition(3, "window_order"), KEYS, CLASSES)
    return ag.aggregation_equivalence(a, b, KEYS, 1e-12).select(*KEYS, "equivalent")


def _rows(spark, d, labelled=None):
    """Windows of the two views with two features as a vector."""
    f = (labelled or ad.labelled_features(spark, d)).select("acquisition_id", "window_order", "canonical_class", (F.col("run_rank") % 2).alias("parity"), F.array("ch_a_mean", "ch_b_mean").alias("x"))
    return f.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("view_id")).withColumn("split_role", F.when(F.col("parity") == F.col("view_id"), "train").otherwise("held_out")).drop("parity")


_DEV = {
    "second": "SELECT view_id, avg(z1 * z1) AS s11, avg(z1 * z2) AS s12, avg(z2 * z2) AS s22, count(*) AS n, avg(pow(z1 * z1 + z2 * z2, 2)) AS fourth FROM view_std WHERE split_role = 'train' GROUP BY view_id",
    "shrunk": "SELECT *, CASE WHEN d2 > 0 THEN greatest(0, least((fourth - sq) / n, d2)) / d2 ELSE 0 END AS a FROM (SELECT *, s11 * s11 + 2 * s12 * s12 + s22 * s22 AS sq, (s11 + s22) / 2 AS mu, s11 * s11 + 2 * s12 * s12 + s22 * s22 - pow(s11 + s22, 2) / 2 AS d2 FROM second)",
    "covs": "SELECT view_id, i, j, CASE WHEN i = 0 AND j = 0 THEN (1 - a) * s11 + a * mu WHEN i = 1 AND j = 1 THEN (1 - a) * s22 + a * mu ELSE (1 - a) * s12 END AS cov FROM shrunk, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j)",
    "precs": "SELECT view_id, c22 / det AS q11, -c12 / det AS q12, c11 / det AS q22 FROM (SELECT *, c11 * c22 - c12 * c12 AS det FROM (SELECT view_id, max(cov) FILTER (i = 0 AND j = 0) AS c11, max(cov) FILTER (i = 0 AND j = 1) AS c12, max(cov) FILTER (i = 1 AND j = 1) AS c22 FROM covs GROUP BY view_id))",
    "dists": "SELECT s.view_id, split_role, acquisition_id, window_order, canonical_class, round(greatest(0, q11 * z1 * z1 + 2 * q12 * z1 * z2 + q22 * z2 * z2), 9) AS d2 FROM view_std s JOIN precs USING (view_id)",
    "scored": "SELECT *, (1 + count(*) FILTER (split_role = 'train') OVER (PARTITION BY view_id ORDER BY d2 RANGE UNBOUNDED PRECEDING))::DOUBLE / (count(*) FILTER (split_role = 'train') OVER (PARTITION BY view_id) + 1) AS deviation FROM dists",
}


def _scored(spark, d, rows=None, scorer=None):
    r = rows or stored(_rows(spark, d), "rows")
    scorer = scorer or de.invert_precision(de.fit_covariance(r, ["view_id"]), ["view_id"])
    m = de.mahalanobis(r, scorer, ["view_id"]).withColumn("d2", F.round("d2", 9))
    return de.deviation_score(m, ["view_id"])


@query("SELECT * FROM covs", "cov", _DEV)
def fit_covariance(spark, d):
    return de.fit_covariance(_rows(spark, d), ["view_id"]).select("view_id", "i", "j", "cov")


@query("SELECT view_id, q11, q12, q22 FROM precs", "q11 q12 q22", _DEV)
def invert_precision(spark, d):
    p = de.invert_precision(de.fit_covariance(_rows(spark, d), ["view_id"]), ["view_id"])
    return p.select("view_id", F.col("precision")[0][0].alias("q11"), F.col("precision")[0][1].alias("q12"), F.col("precision")[1][1].alias("q22"))


@query("SELECT view_id, acquisition_id, window_order, d2 FROM dists", "d2", _DEV)
def mahalanobis(spark, d):
    r = _rows(spark, d)
    return de.mahalanobis(r, de.invert_precision(de.fit_covariance(r, ["view_id"]), ["view_id"]), ["view_id"]).select("view_id", "acquisition_id", "window_order", F.round("d2", 9).alias("d2"))


@query("SELECT view_id, acquisition_id, window_order, deviation FROM scored", "deviation", _DEV)
def deviation_score(spark, d):
    return _scored(spark, d).select("view_id", "acquisition_id", "window_order", "deviation")


@query("SELECT view_id, acquisition_id, window_order, sha256(view_id || '|' || acquisition_id || '|' || window_order || '|' || round(deviation, 6)::DECIMAL(38,6)::VARCHAR) AS score_hash FROM scored WHERE split_role <> 'train'", views=_DEV)
def score_records(spark, d):
    return de.score_records(_scored(spark, d), ["view_id", "acquisition_id", "window_order"]).drop("d2", "deviation")


@query("SELECT view_id, count(*) AS n, min(deviation) AS lowest, avg(deviation) AS mean, max(deviation) AS highest, avg((deviation = 1)::INTEGER) AS saturated FROM scored GROUP BY view_id", "lowest mean highest saturated", _DEV)
def score_distribution(spark, d):
    return de.score_distribution(_scored(spark, d), ["view_id"])


_REF = {
    "refs": f"SELECT view_id, avg(x1) AS m1, CASE WHEN stddev_pop(x1) > 0 THEN stddev_pop(x1) ELSE 1 END AS s1, avg(x2) AS m2, CASE WHEN stddev_pop(x2) > 0 THEN stddev_pop(x2) ELSE 1 END AS s2 FROM view_rows WHERE split_role = 'train' AND canonical_class = '{BASELINE}' GROUP BY view_id",
    "healthy": "SELECT r.*, sqrt((pow((x1 - m1) / s1, 2) + pow((x2 - m2) / s2, 2)) / 2) AS healthy_distance FROM view_rows r JOIN refs USING (view_id)",
    "series": "SELECT vec_id, (i - 1)::INTEGER AS position, v[i] AS v, canonical_class FROM vectors, range(1, 65) t(i)",
    "sref": f"SELECT position, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM series WHERE canonical_class = '{BASELINE}' GROUP BY position",
}


def _series(spark, d):
    return ad.vectors(spark, d).select("vec_id", "canonical_class", F.posexplode("v").alias("position", "v"))


@query("SELECT view_id, m1, s1, m2, s2 FROM refs", "m1 s1 m2 s2", _REF)
def fit_reference(spark, d):
    r = rf.fit_reference(_rows(spark, d), ["view_id"], BASELINE)
    return r.select("view_id", *[F.col(c)[k].alias(f"{n}{k + 1}") for k in (0, 1) for c, n in (("mean", "m"), ("scale", "s"))])


@query("SELECT view_id, acquisition_id, window_order, healthy_distance FROM healthy", "healthy_distance", _REF)
def reference_distance(spark, d):
    r = _rows(spark, d)
    return rf.reference_distance(r, rf.fit_reference(r, ["view_id"], BASELINE), ["view_id"]).select("view_id", "acquisition_id", "window_order", "healthy_distance")


@query("SELECT view_id, k AS variant, ['REFERENCE_OK', 'HEALTHY_REFERENCE_MUST_BE_TRAINING_ONLY', 'HEALTHY_REFERENCE_ASSIGNMENT_MISMATCH', 'HEALTHY_REFERENCE_PROVENANCE_OR_SHAPE_INVALID', 'HEALTHY_REFERENCE_VALUES_INVALID', 'HEALTHY_REFERENCE_SOURCE_HASH_INVALID'][k + 1] AS status FROM refs, (SELECT unnest(range(0, 6))::INTEGER AS k)", views=_REF)
def validate_reference(spark, d):
    """Each reference as it is and with one thing altered, a variant a check."""
    r = rf.fit_reference(_rows(spark, d), ["view_id"], BASELINE).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("variant"))
    k = lambda n: F.col("variant") == n
    name = F.concat(F.lit("view-"), F.col("view_id").cast("string"))
    r = r.withColumn("expected", name).withColumn("assignment_id", F.when(k(2), "another").otherwise(name)).withColumn("source_partitions", F.when(k(1), F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.lit("train"))))
    r = r.withColumn("source_window_hashes", F.array(F.when(k(5), "ABC").otherwise(F.sha2(name, 256)))).withColumn("mean", F.when(k(3), F.slice("mean", 1, 1)).otherwise(F.col("mean"))).withColumn("scale", F.when(k(4), F.transform("scale", lambda x: -x)).otherwise(F.col("scale")))
    return rf.validate_reference(r, 2, "expected").select("view_id", "variant", "status")


@query("SELECT * FROM sref", "m s", _REF)
def fit_series_reference(spark, d):
    return rf.fit_series_reference(_series(spark, d).where(F.col("canonical_class") == BASELINE))


@query("SELECT vec_id, sqrt(avg(pow((v - m) / s, 2))) AS distance, coalesce(sum(t), 0) AS area FROM (SELECT *, (abs(v - m) + lag(abs(v - m)) OVER (PARTITION BY vec_id ORDER BY position)) / 2 AS t FROM series JOIN sref USING (position)) GROUP BY vec_id", "distance area", _REF)
def series_distance_area(spark, d):
    s = _series(spark, d)
    return rf.series_distance_area(s, rf.fit_series_reference(s.where(F.col("canonical_class") == BASELINE)), "vec_id")


@query("SELECT vec_id, min(position) FILTER (v >= 0.2) AS crossing FROM series GROUP BY vec_id", views=_REF)
def first_crossing(spark, d):
    return rf.first_crossing(_series(spark, d), "vec_id", 0.2)
