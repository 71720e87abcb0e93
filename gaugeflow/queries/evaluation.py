"""Evaluation aggregates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as me
from ..plans import adapters as ad
from ._registry import query

GB = ("bad", "good")
_V = {
    "cm": "SELECT m.model, t.truth, p.predicted, count(e.row_id) AS n FROM (SELECT DISTINCT model FROM class_eval) m, (VALUES ('bad'), ('good')) t(truth), (VALUES ('bad'), ('good')) p(predicted) LEFT JOIN class_eval e ON e.model = m.model AND e.truth = t.truth AND e.predicted = p.predicted GROUP BY ALL",
    "report": """SELECT model, class, coalesce(tp / nullif(chosen, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(chosen + support, 0), 0) AS f1, support FROM (SELECT model, c AS class, (sum(n) FILTER (truth = c AND predicted = c))::DOUBLE AS tp, (sum(n) FILTER (truth = c))::BIGINT AS support, (sum(n) FILTER (predicted = c))::BIGINT AS chosen FROM cm, (VALUES ('bad'), ('good')) k(c) GROUP BY ALL)""",
    "summary": "SELECT model, accuracy, balanced_accuracy, macro_f1 FROM (SELECT model, (sum(n) FILTER (truth = predicted))::DOUBLE / sum(n) AS accuracy FROM cm GROUP BY model) JOIN (SELECT model, avg(recall) FILTER (support > 0) AS balanced_accuracy, avg(f1) AS macro_f1 FROM report GROUP BY model) USING (model)",
    "by_source": "SELECT source, model, unnest(['accuracy', 'confidence']) AS metric, unnest([avg((truth = predicted)::INTEGER), avg(greatest(p[1], p[2]))]) AS value FROM class_eval GROUP BY source, model",
    "components": "SELECT case_id, diagnosis, unnest(['risk', 'ood', 'missing']) AS component, unnest([risk_score, least(1.0, ood_score), missing_ratio]) AS value FROM case_facts",
}


def _cm(spark, d):
    return me.confusion_matrix(ad.class_eval(spark, d), GB)


def _by_source(spark, d):
    e = ad.class_eval(spark, d).groupBy("source", "model").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg(F.array_max("p")).alias("confidence"))
    return me.metrics_long(e, ["source", "model"])


def _components(spark, d):
    c = ad.case_facts(spark, d)
    rows = F.array(*[F.struct(F.lit(n).alias("component"), v.alias("value")) for n, v in (("risk", F.col("risk_score")), ("ood", F.least(F.lit(1.0), F.col("ood_score"))), ("missing", F.col("missing_ratio")))])
    return c.select("case_id", "diagnosis", F.explode(rows).alias("r")).select("case_id", "diagnosis", "r.*")


@query("SELECT row_id, model, truth, predicted, truth = predicted AS correct, truth || '->' || predicted AS category FROM class_eval")
def join_labels_late(spark, d):
    e = ad.class_eval(spark, d)
    labels = ad.table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.element_at(F.array(F.lit("bad"), F.lit("good")), F.col("quality") + 1).alias("truth"))
    return me.join_labels(e.select("row_id", "model", "predicted"), labels, ["row_id"])


@query("SELECT * FROM cm", views=_V)
def confusion_matrix(spark, d):
    return _cm(spark, d)


@query("SELECT * FROM report", "precision recall f1", _V)
def class_report(spark, d):
    return me.class_report(_cm(spark, d))


@query("SELECT * FROM summary", "accuracy balanced_accuracy macro_f1", _V)
def summary_metrics(spark, d):
    return me.summary_metrics(_cm(spark, d))


@query("SELECT model, avg(-ln(greatest(CASE truth WHEN 'bad' THEN p[1] ELSE p[2] END, 1e-15))) AS log_loss FROM class_eval GROUP BY model", "log_loss")
def log_loss(spark, d):
    return me.log_loss(ad.class_eval(spark, d), GB)


@query("SELECT model, avg(pow(p[1] - (truth = 'bad')::INTEGER, 2) + pow(p[2] - (truth = 'good')::INTEGER, 2)) AS brier FROM class_eval GROUP BY model", "brier")
def brier(spark, d):
    return me.brier(ad.class_eval(spark, d), GB)


@query("SELECT model, sum(n * abs(acc - conf)) / sum(n) AS ece FROM (SELECT model, least(floor(round(greatest(p[1], p[2]) * 10, 9)), 9) AS b, count(*) AS n, avg((truth = predicted)::INTEGER) AS acc, avg(greatest(p[1], p[2])) AS conf FROM class_eval GROUP BY model, b) GROUP BY model", "ece")
def calibration_error(spark, d):
    return me.calibration_error(ad.class_eval(spark, d))


@query("SELECT model, avg(greatest(p[1], p[2])) AS mean_max_probability FROM class_eval GROUP BY model", "mean_max_probability")
def mean_max_probability(spark, d):
    return me.mean_max_probability(ad.class_eval(spark, d))


@query("SELECT model, unnest(['accuracy', 'balanced_accuracy', 'macro_f1']) AS metric, unnest([accuracy, balanced_accuracy, macro_f1]) AS value FROM summary", "value", _V)
def metrics_long(spark, d):
    return me.metrics_long(me.summary_metrics(_cm(spark, d)), ["model"])


@query("SELECT model, avg(value) FILTER (metric = 'accuracy') AS accuracy, avg(value) FILTER (metric = 'confidence') AS confidence FROM by_source GROUP BY model", "accuracy confidence", _V)
def metrics_by_group(spark, d):
    return me.metrics_by_group(_by_source(spark, d), "model", ["accuracy", "confidence"])


@query("SELECT model, metric, median(value) AS median FROM by_source GROUP BY ALL", "median", _V)
def metric_median(spark, d):
    return me.metric_median(_by_source(spark, d), ["model", "metric"])


@query("SELECT source, CASE WHEN x IS NULL OR y IS NULL THEN 'UNPAIRED' ELSE l END AS level, CASE WHEN x IS NULL OR y IS NULL THEN coalesce(x, y) WHEN l = 'short' THEN x ELSE y END AS value FROM (SELECT source, value AS x FROM by_source WHERE model = 'cut_400' AND metric = 'accuracy') FULL JOIN (SELECT source, value AS y FROM by_source WHERE model = 'cut_1200' AND metric = 'accuracy' AND source <> 'src3') USING (source), (VALUES ('short'), ('long')) t(l) WHERE NOT ((x IS NULL OR y IS NULL) AND l = 'long')", "value", _V)
def paired_levels(spark, d):
    s = _by_source(spark, d).where("metric = 'accuracy'")
    return me.paired_levels(s.where("model = 'cut_400'"), s.where("model = 'cut_1200' AND source <> 'src3'"), ["source"], ("short", "long"))


@query("SELECT truth, predicted, sum(n)::BIGINT AS n FROM cm GROUP BY ALL", views=_V)
def sum_confusions(spark, d):
    return me.sum_confusions(_cm(spark, d), [])


@query("SELECT view_id, acquisition_id, window_order, unnest(['confidence', 'entropy']) AS measure, unnest([confidence, entropy]) AS value FROM predictions", "value")
def prediction_spread(spark, d):
    return me.prediction_spread(ad.predictions(spark, d), ["view_id", "acquisition_id", "window_order"])


@query("SELECT component, value, max(c) AS cumulative FROM (SELECT component, round(value, 6) AS value, cume_dist() OVER (PARTITION BY component ORDER BY round(value, 6)) AS c FROM components) GROUP BY ALL", "value cumulative", _V)
def component_ecdf(spark, d):
    return me.component_ecdf(_components(spark, d).withColumn("value", F.round("value", 6)))


@query("SELECT component, avg((round(value, 6) = 1)::INTEGER) AS saturated, count(DISTINCT round(value, 6)) AS distinct_values FROM components GROUP BY ALL", "saturated", _V)
def saturation_and_resolution(spark, d):
    return me.saturation(_components(spark, d).withColumn("value", F.round("value", 6)))


@query("SELECT component, diagnosis, avg(value) AS mean FROM components GROUP BY GROUPING SETS ((component), (component, diagnosis))", "mean", _V)
def component_means(spark, d):
    return me.component_means(_components(spark, d), ["diagnosis"])


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS a, count(*) FILTER (user_id % 3 = 1) AS b, count(*) FILTER (user_id % 3 = 2) AS c FROM events GROUP BY event_type")
def crosstab(spark, d):
    e = ad.table(spark, d, "events").select("event_type", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3 + 1).cast("int")).alias("k"))
    return me.crosstab(e, "event_type", "k", ["a", "b", "c"])


_SIM = {"brands": "SELECT p_brand AS g, list(DISTINCT p_size) AS s FROM part GROUP BY p_brand", "sims": "SELECT a.g AS a, b.g AS b, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS jaccard FROM brands a, brands b"}


def _sims(spark, d):
    from ..operators import ml

    return ml.pairwise_jaccard(ad.table(spark, d, "part").select("p_brand", F.col("p_size").alias("feature")).distinct(), "p_brand")


@query("SELECT true AS complete, true AS unit_diagonal, true AS symmetric, min(jaccard) AS lowest, median(jaccard) AS median, max(jaccard) AS highest FROM sims WHERE a < b", "lowest median highest", _SIM)
def similarity_matrix(spark, d):
    return me.similarity_matrix(_sims(spark, d))


@query("SELECT least(floor(round(jaccard * 20, 9)), 19)::INTEGER AS bin, count(*) AS n FROM sims WHERE a < b GROUP BY ALL", views=_SIM)
def similarity_histogram(spark, d):
    return me.similarity_histogram(_sims(spark, d))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, round(p_retailprice, 9) ORDER BY p_partkey) - 1 AS stack FROM part")
def tie_stacks(spark, d):
    return me.tie_stacks(ad.table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_partkey").select("p_partkey", "stack")


@query("SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END::BIGINT AS position FROM orders")
def order_by_list(spark, d):
    o = me.order_by_list(ad.table(spark, d, "orders"), "o_orderpriority", ["5-LOW", "1-URGENT"])
    return o.select("o_orderkey", "o_orderpriority", F.col("position").cast("long").alias("position"))


@query("SELECT c_name AS feature, c_acctbal AS contribution FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_name) AS lo, row_number() OVER (ORDER BY c_acctbal DESC, c_name) AS hi FROM customer) WHERE lo <= 8 OR hi <= 8", "contribution")
def contribution_extremes(spark, d):
    return me.contribution_extremes(ad.table(spark, d, "customer").select(F.col("c_name").alias("feature"), F.col("c_acctbal").alias("contribution")), 8)
