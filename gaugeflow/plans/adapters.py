"""Views that stand for the library's own tables, derived from the given ones: in Spark, and as DuckDB text for the checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import features as fe
from ..schemas import CLASSES

WIDTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(acquisition_id, sample, ch_a, ch_b): each user's events in order."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("ch_b"))
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("acquisition_id"), (n - 1).cast("long").alias("sample"), F.col("value").alias("ch_a"), "ch_b")


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(acquisition_id, canonical_class, run_rank)."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("acquisition_id")).distinct()
    named = ids.select("acquisition_id", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("acquisition_id") % 4 + 1).cast("int")).alias("canonical_class"))
    return named.withColumn("run_rank", F.dense_rank().over(W.partitionBy("canonical_class").orderBy("acquisition_id")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(acquisition_id, window_order, 22 time features) of the windows of eight samples."""
    return fe.time_features(samples(spark, sf_dir), ("ch_a", "ch_b"), WIDTH)


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).join(acquisitions(spark, sf_dir), "acquisition_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, v, canonical_class, group_id)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("label") % 4 + 1).cast("int")).alias("canonical_class"), (F.col("vec_id") % 10).cast("int").alias("group_id"))


def predictions(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """(view_id, acquisition_id, window_order, p, predicted_class, confidence, entropy) for every window and view.

    `labelled` are the labelled features where they are at hand. The scorer is the softmax of minus half the squared distances to the class means of the even (view 0) or odd (view 1)
    runs, over two standardised features.
    """
    from ..operators import ml

    f = (labelled or labelled_features(spark, sf_dir)).select("acquisition_id", "window_order", "canonical_class", (F.col("run_rank") % 2).alias("parity"), F.array("ch_a_mean", "ch_b_mean").alias("x"))
    views = f.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("view_id")).withColumn("split_role", F.when(F.col("parity") == F.col("view_id"), "train").otherwise("held_out"))
    scored = ml.centroid_probabilities(views, ["view_id"], "x", CLASSES)
    return ml.predict_records(scored, CLASSES).select("view_id", "split_role", "acquisition_id", "window_order", "p", "predicted_class", "confidence", "entropy")


def class_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, model, truth, predicted, p): a length rule against the quality labels, two thresholds being two models."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), "source")
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    j = j.select("*", F.explode(F.array(F.lit(400.0), F.lit(1200.0))).alias("cut"))
    s = F.col("n") / (F.col("n") + F.col("cut"))
    p = F.array(1 - s, s)
    return j.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("cut_"), F.col("cut").cast("int").cast("string")).alias("model"), "source", F.element_at(F.array(F.lit("bad"), F.lit("good")), F.col("quality") + 1).alias("truth"), F.when(F.col("n") > F.col("cut"), "good").otherwise("bad").alias("predicted"), p.alias("p"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, event_index, payload): the turns of each conversation as events."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).cast("long").alias("event_index"), F.concat_ws(":", "role", "text").alias("payload"))


def case_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of facts for each order."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.count("*").alias("lines"))
    o = table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("case_id"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 600007).alias("risk_score"),
        (1 - F.round("disc", 9) * 5).alias("confidence"),
        (F.round("tax", 9) * 10).alias("ood_score"),
        ((k % 20).cast("double") / 100).alias("missing_ratio"),
        (1 - (k % 20).cast("double") / 40).alias("data_quality"),
        F.when(k % 7 != 0, (k % 11).cast("double") / 10).alias("explanation_score"),
        (k % 7 != 0).alias("explanation_available"),
        ((k % 13).cast("double") / 12).alias("representation_disagreement"),
        ((k % 17).cast("double") / 16).alias("classifier_disagreement"),
        (1 - (k % 9).cast("double") / 10).alias("domain_consistency_score"),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("o_custkey") % 4 + 1).cast("int")).alias("diagnosis"),
        (F.col("o_orderstatus") == "F").alias("conflict"),
        (F.col("o_orderstatus") != "P").alias("spline_fit_valid"),
        (k % 19 != 0).alias("audit_available"),
    )


def raw_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as text cells, with missing and infinite spellings put in."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    bal = F.when(k % 11 == 0, "NA").when(k % 13 == 0, "inf").when(k % 17 == 0, "").otherwise(F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string"))
    return c.select(F.when(k % 5 == 0, k - 1).otherwise(k).cast("string").alias("custkey"), F.col("c_nationkey").cast("string").alias("nationkey"), bal.alias("acctbal"), F.when(k % 7 == 0, " null ").otherwise(F.col("c_mktsegment")).alias("mktsegment"), F.when(k % 2 == 0, "True").otherwise("false").alias("flag"), F.lit("nan").alias("nothing"))


_CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


def _moments(c: str) -> str:
    """The eleven time features of a channel, as DuckDB aggregates."""
    s = f"stddev_pop({c})"
    m3 = f"(avg({c}**3) - 3 * avg({c}) * avg({c}**2) + 2 * avg({c})**3)"
    m4 = f"(avg({c}**4) - 4 * avg({c}) * avg({c}**3) + 6 * avg({c})**2 * avg({c}**2) - 3 * avg({c})**4)"
    rms = f"sqrt(avg({c} * {c}))"
    return ", ".join([
        f"avg({c}) AS {c}_mean", f"{s} AS {c}_std", f"var_pop({c}) AS {c}_variance", f"{rms} AS {c}_rms", f"max({c}) AS {c}_max", f"min({c}) AS {c}_min",
        f"max(abs({c})) AS {c}_peak", f"max({c}) - min({c}) AS {c}_peak_to_peak",
        f"CASE WHEN {s} = 0 THEN 0 ELSE {m3} / {s}**3 END AS {c}_skewness", f"CASE WHEN {s} = 0 THEN 0 ELSE {m4} / {s}**4 - 3 END AS {c}_kurtosis",
        f"CASE WHEN {rms} = 0 THEN 0 ELSE max(abs({c})) / {rms} END AS {c}_crest",
    ])


#: DuckDB text of the views above; a view may use those before it.
VIEWS = {
    "samples": "SELECT user_id AS acquisition_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample, value AS ch_a, (props->>'k')::DOUBLE AS ch_b FROM events",
    "acquisitions": f"SELECT acquisition_id, {_CLASS_LIST}[acquisition_id % 4 + 1] AS canonical_class, dense_rank() OVER (PARTITION BY acquisition_id % 4 ORDER BY acquisition_id) AS run_rank FROM (SELECT DISTINCT user_id AS acquisition_id FROM events)",
    "features": f"SELECT acquisition_id, sample // {WIDTH} AS window_order, {_moments('ch_a')}, {_moments('ch_b')} FROM samples GROUP BY ALL HAVING count(*) = {WIDTH}",
    "labelled_features": "SELECT * FROM features JOIN acquisitions USING (acquisition_id)",
    "vectors": f"SELECT vec_id, embedding::DOUBLE[] AS v, {_CLASS_LIST}[label % 4 + 1] AS canonical_class, (vec_id % 10)::INTEGER AS group_id FROM embeddings",
    "view_rows": "SELECT acquisition_id, window_order, canonical_class, view_id, CASE WHEN run_rank % 2 = view_id THEN 'train' ELSE 'held_out' END AS split_role, ch_a_mean AS x1, ch_b_mean AS x2 FROM labelled_features, (VALUES (0), (1)) v(view_id)",
    "view_scale": "SELECT view_id, avg(x1) AS m1, CASE WHEN stddev_pop(x1) > 0 THEN stddev_pop(x1) ELSE 1 END AS s1, avg(x2) AS m2, CASE WHEN stddev_pop(x2) > 0 THEN stddev_pop(x2) ELSE 1 END AS s2 FROM view_rows WHERE split_role = 'train' GROUP BY view_id",
    "view_std": "SELECT r.*, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM view_rows r JOIN view_scale USING (view_id)",
    "view_means": "SELECT view_id, canonical_class AS c, avg(z1) AS c1, avg(z2) AS c2 FROM view_std WHERE split_role = 'train' GROUP BY ALL",
    "view_logits": "SELECT s.view_id, split_role, acquisition_id, window_order, c, -((z1 - c1)**2 + (z2 - c2)**2) / 2 AS logit FROM view_std s JOIN view_means m USING (view_id)",
    "view_probs": "SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit - m)) OVER w AS p FROM (SELECT *, max(logit) OVER w AS m FROM view_logits WINDOW w AS (PARTITION BY view_id, acquisition_id, window_order)) WINDOW w AS (PARTITION BY view_id, acquisition_id, window_order)",
    "predictions": f"SELECT view_id, split_role, acquisition_id, window_order, list(p ORDER BY list_position({_CLASS_LIST}, c)) AS p, arg_max(c, (round(p, 12), -list_position({_CLASS_LIST}, c))) AS predicted_class, max(p) AS confidence, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(4) AS entropy FROM view_probs GROUP BY ALL",
    "class_eval": "SELECT doc_id AS row_id, 'cut_' || cut AS model, source, ['bad', 'good'][quality + 1] AS truth, CASE WHEN n_chars > cut THEN 'good' ELSE 'bad' END AS predicted, [1 - n_chars::DOUBLE / (n_chars + cut), n_chars::DOUBLE / (n_chars + cut)] AS p FROM documents JOIN labels USING (doc_id), (VALUES (400), (1200)) v(cut)",
    "audit_log": "SELECT conv_id AS run_id, turn + 1 AS event_index, concat_ws(':', role, text) AS payload FROM conversations",
    "case_facts": f"""SELECT k AS case_id, least(1.0, o_totalprice / 600007) AS risk_score, 1 - round(disc, 9) * 5 AS confidence, round(tax, 9) * 10 AS ood_score, (k % 20)::DOUBLE / 100 AS missing_ratio, 1 - (k % 20)::DOUBLE / 40 AS data_quality,
CASE WHEN k % 7 <> 0 THEN (k % 11)::DOUBLE / 10 END AS explanation_score, k % 7 <> 0 AS explanation_available, (k % 13)::DOUBLE / 12 AS representation_disagreement, (k % 17)::DOUBLE / 16 AS classifier_disagreement, 1 - (k % 9)::DOUBLE / 10 AS domain_consistency_score,
{_CLASS_LIST}[o_custkey % 4 + 1] AS diagnosis, o_orderstatus = 'F' AS conflict, o_orderstatus <> 'P' AS spline_fit_valid, k % 19 <> 0 AS audit_available
FROM (SELECT *, o_orderkey AS k FROM orders) LEFT JOIN (SELECT l_orderkey, avg(l_discount) AS disc, avg(l_tax) AS tax FROM lineitem GROUP BY ALL) ON k = l_orderkey""",
    "raw_strings": """SELECT (CASE WHEN k % 5 = 0 THEN k - 1 ELSE k END)::VARCHAR AS custkey, c_nationkey::VARCHAR AS nationkey, CASE WHEN k % 11 = 0 THEN 'NA' WHEN k % 13 = 0 THEN 'inf' WHEN k % 17 = 0 THEN '' ELSE round(c_acctbal, 2)::DECIMAL(18,2)::VARCHAR END AS acctbal,
CASE WHEN k % 7 = 0 THEN ' null ' ELSE c_mktsegment END AS mktsegment, CASE WHEN k % 2 = 0 THEN 'True' ELSE 'false' END AS flag, 'nan' AS nothing FROM (SELECT *, c_custkey AS k FROM customer)""",
}


def with_views(sql: str, own: dict[str, str] | None = None) -> str:
    """The query with the views that it uses, themselves or through others, as common table expressions."""
    views = VIEWS | (own or {})
    used: list[str] = []
    seen: set[str] = set()

    def walk(text: str) -> None:
        for name, body in views.items():
            if name not in seen and re.search(rf"\b(FROM|JOIN|,) \(?{name}\b", text):
                seen.add(name)
                walk(body)
                used.append(name)

    walk(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in used) + "\n" if used else "") + sql
