"""Preparation and scoring (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml, metrics as me
from ..plans import adapters as ad
from ..schemas import CLASSES
from ._registry import query

_RAW = {
    "raw_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'held_out' ELSE 'train' END AS split_role, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS x, CASE WHEN o_orderkey % 5 = 0 THEN 'inf'::DOUBLE ELSE o_custkey::DOUBLE END AS y FROM orders",
    "train_rows": "SELECT CASE WHEN isfinite(x) THEN x END AS x, CASE WHEN isfinite(y) THEN y END AS y FROM raw_rows WHERE split_role = 'train'",
}


def _raw(spark, d):
    o = ad.table(spark, d, "orders")
    k = F.col("o_orderkey")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return o.select(k, F.when(k % 3 == 0, "held_out").otherwise("train").alias("split_role"), F.when(k % 7 == 0, None).when(k % 11 == 0, nan).otherwise(F.col("o_totalprice")).alias("x"), F.when(k % 5 == 0, inf).otherwise(F.col("o_custkey").cast("double")).alias("y"))


def _imputed(how: str) -> str:
    return f"SELECT o_orderkey, split_role, CASE WHEN isfinite(x) THEN x ELSE mx END AS x, CASE WHEN isfinite(y) THEN y ELSE my END AS y FROM raw_rows, (SELECT {how}(x) AS mx, {how}(y) AS my FROM train_rows)"


@query(_imputed("avg"), "x y", _RAW)
def impute_mean_train(spark, d):
    return ml.impute_train(_raw(spark, d), ["x", "y"], "mean")


@query(_imputed("median"), "x y", _RAW)
def impute_median_train(spark, d):
    return ml.impute_train(_raw(spark, d), ["x", "y"], "median")


@query("SELECT o_orderkey, split_role, (x - mx) / sx AS x, (y - my) / sy AS y FROM (" + _imputed("avg") + "), (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM (" + _imputed("avg") + ") WHERE split_role = 'train')", "x y", _RAW)
def standardize_train(spark, d):
    return ml.standardize_train(ml.impute_train(_raw(spark, d), ["x", "y"], "mean"), ["x", "y"])


@query("SELECT event_id, 0.0::DOUBLE AS p0, value / (value + k + 1) AS p1, k / (value + k + 1) AS p2, 1 / (value + k + 1) AS p3 FROM (SELECT event_id, greatest(0, value) AS value, (props->>'k')::DOUBLE AS k FROM events)", "p0 p1 p2 p3")
def canonical_probabilities(spark, d):
    e = ad.table(spark, d, "events").select("event_id", F.create_map(F.lit(CLASSES[2]), F.get_json_object("props", "$.k").cast("double"), F.lit(CLASSES[1]), F.col("value"), F.lit(CLASSES[3]), F.lit(1.0)).alias("m"))
    p = e.select("event_id", ml.canonical_probabilities("m", CLASSES).alias("p"))
    return p.select("event_id", *[F.col("p")[k].alias(f"p{k}") for k in range(4)])


@query("SELECT view_id, acquisition_id, window_order, predicted_class, confidence FROM predictions", "confidence")
def predict_records(spark, d):
    return ad.predictions(spark, d).select("view_id", "acquisition_id", "window_order", "predicted_class", "confidence")


_LIN = {
    "coefs": "SELECT class, feature, coef FROM (VALUES ('a', 'intercept', 0.1), ('a', 'risk', 1.5), ('a', 'ood', -0.5), ('b', 'intercept', -0.2), ('b', 'risk', -1.0), ('b', 'ood', 2.0), ('c', 'risk', 0.3), ('c', 'ood', 0.4)) t(class, feature, coef)",
    "xs": "SELECT case_id, unnest(['risk', 'ood']) AS feature, unnest([risk_score, coalesce(ood_score, 0)]) AS x FROM case_facts",
    "logits": "SELECT case_id, class, s + coalesce((SELECT coef FROM coefs i WHERE i.class = t.class AND i.feature = 'intercept'), 0) AS logit FROM (SELECT case_id, class, sum(x * coef::DOUBLE) AS s FROM xs JOIN coefs USING (feature) GROUP BY ALL) t",
}


def _coefs(spark):
    return spark.createDataFrame([("a", "intercept", 0.1), ("a", "risk", 1.5), ("a", "ood", -0.5), ("b", "intercept", -0.2), ("b", "risk", -1.0), ("b", "ood", 2.0), ("c", "risk", 0.3), ("c", "ood", 0.4)], "class string, feature string, coef double")


def _xs(spark, d):
    c = ad.case_facts(spark, d)
    rows = F.array(F.struct(F.lit("risk").alias("feature"), F.col("risk_score").alias("x")), F.struct(F.lit("ood").alias("feature"), F.coalesce("ood_score", F.lit(0.0)).alias("x")))
    return c.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.*")


@query("SELECT case_id, class, logit, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS probability FROM logits WINDOW w AS (PARTITION BY case_id)", "logit probability", _LIN)
def linear_scores(spark, d):
    return ml.linear_scores(_xs(spark, d), _coefs(spark), ["case_id"])


@query("SELECT case_id, class, feature, x * coef::DOUBLE AS contribution, 0.0::DOUBLE AS residual FROM (SELECT case_id, arg_max(class, (round(logit, 9), class)) AS class FROM logits GROUP BY case_id) JOIN xs USING (case_id) JOIN coefs USING (class, feature)", "contribution residual", _LIN)
def local_contributions(spark, d):
    x, c = _xs(spark, d), _coefs(spark)
    return ml.local_contributions(x, c, ["case_id"], ml.linear_scores(x, c, ["case_id"]))


_PERM = {
    "perm_rows": "SELECT row_id, n AS x1, length(source)::DOUBLE AS x2, truth FROM (SELECT e.row_id, d.n_chars::DOUBLE AS n, d.source, truth FROM class_eval e JOIN documents d ON d.doc_id = e.row_id WHERE model = 'cut_400')",
    "perm": "SELECT r.i AS repeat, f.feature, row_id, row_number() OVER (PARTITION BY r.i, f.feature ORDER BY sha256('s3|own|' || row_id), row_id) AS own, row_number() OVER (PARTITION BY r.i, f.feature ORDER BY sha256('s3|' || r.i || '|' || f.feature || '|' || row_id), row_id) AS other FROM perm_rows, range(0, 3) r(i), (VALUES ('x1'), ('x2')) f(feature)",
    "donors": "SELECT a.repeat, a.feature, a.row_id, b.row_id AS donor FROM perm a JOIN perm b ON a.repeat = b.repeat AND a.feature = b.feature AND a.own = b.other",
    "hits": "SELECT repeat, feature, r.truth, ((CASE WHEN feature = 'x1' THEN o.x1 ELSE r.x1 END) + 100 * (CASE WHEN feature = 'x2' THEN o.x2 ELSE r.x2 END) > 800) = (r.truth = 'good') AS hit FROM donors JOIN perm_rows r USING (row_id) JOIN perm_rows o ON o.row_id = donor",
    "base_hits": "SELECT truth, avg(((x1 + 100 * x2 > 800) = (truth = 'good'))::INTEGER) AS recall FROM perm_rows GROUP BY truth",
    "drops": "SELECT repeat, feature, (SELECT avg(recall) FROM base_hits) - avg(recall) AS drop FROM (SELECT repeat, feature, truth, avg(hit::INTEGER) AS recall FROM hits GROUP BY ALL) GROUP BY ALL",
}


def _perm_rows(spark, d):
    e = ad.class_eval(spark, d).where("model = 'cut_400'").select("row_id", "truth")
    docs = ad.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("x1"), F.length("source").cast("double").alias("x2"))
    return docs.join(e, "row_id")


def _drops(spark, d):
    """Balanced accuracy lost by each feature's permutations, for the rule x1 + 100 x2 > 800."""
    rows = _perm_rows(spark, d)
    donors = ml.permuted_scores(rows, 3, ["x1", "x2"], "s3")
    other = rows.select(F.col("row_id").alias("donor"), F.col("x1").alias("o1"), F.col("x2").alias("o2"))
    j = donors.join(rows, "row_id").join(other, "donor")
    x1, x2 = F.when(F.col("feature") == "x1", F.col("o1")).otherwise(F.col("x1")), F.when(F.col("feature") == "x2", F.col("o2")).otherwise(F.col("x2"))
    good = F.col("truth") == "good"
    hits = j.select("repeat", "feature", "truth", (((x1 + 100 * x2) > 800) == good).cast("double").alias("hit"))
    base = rows.select("truth", (((F.col("x1") + 100 * F.col("x2")) > 800) == good).cast("double").alias("hit")).groupBy("truth").agg(F.avg("hit").alias("r")).agg(F.avg("r").alias("base"))
    acc = hits.groupBy("repeat", "feature", "truth").agg(F.avg("hit").alias("r")).groupBy("repeat", "feature").agg(F.avg("r").alias("acc"))
    return acc.crossJoin(F.broadcast(base)).select("repeat", "feature", (F.col("base") - F.col("acc")).alias("drop"))  # one row


@query("SELECT repeat::INTEGER AS repeat, feature, drop FROM drops", "drop", _PERM)
def permutation_drops(spark, d):
    return _drops(spark, d)


@query("SELECT feature, avg(drop) AS importance, stddev_pop(drop) AS std, count(*) AS repeats FROM drops GROUP BY feature", "importance std", _PERM)
def permutation_importance(spark, d):
    return _drops(spark, d).groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"), F.count("*").alias("repeats"))


_TOP = {
    "imp": "SELECT n_regionkey AS view_id, 'f' || (o_custkey % 12) AS feature, round(sum(o_totalprice), 2) AS importance FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "top5": "SELECT view_id, feature, (row_number() OVER (PARTITION BY view_id ORDER BY importance DESC, feature))::INTEGER AS rank FROM imp QUALIFY rank <= 5",
}


def _top(spark, d):
    o = ad.table(spark, d, "orders").join(ad.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(ad.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    imp = o.groupBy(F.col("n_regionkey").alias("view_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 12).cast("string")).alias("feature")).agg(F.round(F.sum("o_totalprice"), 2).alias("importance"))
    return ml.topk_features(imp, 5)


@query("SELECT * FROM top5", views=_TOP)
def topk_features(spark, d):
    return _top(spark, d)


@query("SELECT feature, count(*)::DOUBLE / (SELECT count(DISTINCT view_id) FROM top5) AS frequency FROM top5 GROUP BY feature", "frequency", _TOP)
def feature_frequency(spark, d):
    return ml.feature_frequency(_top(spark, d))


@query("SELECT a.view_id AS a, b.view_id AS b, count(*) FILTER (a.feature = b.feature)::DOUBLE / (10 - count(*) FILTER (a.feature = b.feature)) AS jaccard FROM top5 a, top5 b GROUP BY ALL", "jaccard", _TOP)
def pairwise_jaccard(spark, d):
    return ml.pairwise_jaccard(_top(spark, d))


@query("SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'ONLY_FIRST' WHEN o_orderkey % 10 = 1 THEN 'DIFFERENT' ELSE 'EQUIVALENT' END AS verdict, count(*) AS n FROM orders GROUP BY 1")
def replay_compare(spark, d):
    a = ad.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = a.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 1, "?").otherwise(F.col("o_orderstatus")))
    return ml.replay_compare(a, b, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("SELECT count(*) AS rows_checked, false AS all_equal FROM orders")
def label_equivalence(spark, d):
    a = ad.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return ml.label_equivalence(a, a.where("o_orderkey <> 0"), ["o_orderkey"], "label")


@query("SELECT o_orderstatus, (SELECT count(*) FROM orders)::DOUBLE / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)) AS weight FROM orders GROUP BY o_orderstatus", "weight")
def class_weights(spark, d):
    return ml.class_weights(ad.table(spark, d, "orders"), "o_orderstatus")


_COLS = ["ch_a_mean", "ch_a_std", "ch_a_peak", "ch_b_mean", "ch_b_std", "ch_b_peak"]


def _fit(spark, d, kind: str, **params):
    f = ad.labelled_features(spark, d).withColumn("split_role", F.when(F.col("run_rank") % 2 == 0, "train").otherwise("held_out"))
    f = ml.standardize_train(ml.impute_train(f, _COLS), _COLS)
    out = ml.fit_predict(f, _COLS, CLASSES, kind, ["acquisition_id", "window_order"], **params)
    return out.select("acquisition_id", "window_order", "predicted_class", "confidence", "entropy")


@query()
def fit_logistic(spark, d):
    return _fit(spark, d, "logistic", iterations=20)


@query()
def fit_forest(spark, d):
    return _fit(spark, d, "forest", trees=10, depth=6)


@query()
def fit_boosted(spark, d):
    return _fit(spark, d, "boosted", iterations=3)


@query()
def supervised_experiment(spark, d):
    """Impute, scale, fit and evaluate: the summary metrics of the logistic model by acquisition class."""
    p = _fit(spark, d, "logistic", iterations=20).join(ad.acquisitions(spark, d), "acquisition_id")
    rows = p.select(F.lit("logistic").alias("model"), F.col("canonical_class").alias("truth"), F.col("predicted_class").alias("predicted"))
    return me.summary_metrics(me.confusion_matrix(rows, CLASSES))
