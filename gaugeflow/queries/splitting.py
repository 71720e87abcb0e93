"""Views, splits and plans (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as sp
from ..plans import adapters as ad
from ..schemas import BASELINE, CLASSES
from ._registry import query

_VIEWS = {
    "views": f"SELECT ((run_rank - 1) // 2)::INTEGER AS block, v.i::INTEGER AS view_id, acquisition_id, canonical_class, CASE WHEN (run_rank - 1) % 2 = (v.i >> (list_position({ad._CLASS_LIST}, canonical_class) - 1)::INTEGER) & 1 THEN 'train' ELSE 'held_out' END AS split_role FROM acquisitions, range(0, 16) v(i)",
    "view_windows": "SELECT block, view_id, acquisition_id, window_order, canonical_class, split_role, ch_a_mean FROM views JOIN features USING (acquisition_id)",
    "cust_groups": "SELECT c_nationkey, row_number() OVER (ORDER BY sha256('s1|' || c_nationkey), c_nationkey) AS r, count(*) OVER () AS g FROM (SELECT DISTINCT c_nationkey FROM customer)",
    "cust_split": "SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN r <= a THEN 'train' WHEN r <= b AND r < g THEN 'validation' ELSE 'test' END AS split_role FROM customer JOIN (SELECT *, least(greatest(1, round_even(g * 0.6, 0)), g - 1) AS a, least(greatest(least(greatest(1, round_even(g * 0.6, 0)), g - 1) + 1, round_even(g * 0.8, 0)), g - 1) AS b FROM cust_groups) USING (c_nationkey)",
}


def _views(spark, d):
    return sp.exhaustive_views(ad.acquisitions(spark, d), CLASSES)


def _split(spark, d):
    return sp.group_split(ad.table(spark, d, "customer"), "c_nationkey", "s1")


@query("SELECT * FROM views", views=_VIEWS)
def exhaustive_views(spark, d):
    return _views(spark, d)


@query("SELECT block, view_id, acquisition_id, window_order, split_role, ch_a_mean FROM view_windows", "ch_a_mean", _VIEWS)
def materialize_view(spark, d):
    return sp.materialize_view(_views(spark, d), ad.features(spark, d)).select("block", "view_id", "acquisition_id", "window_order", "split_role", "ch_a_mean")


@query("SELECT block, view_id, count(*) FILTER (split_role = 'train') AS train_n, count(*) FILTER (split_role = 'held_out') AS held_n, 0::BIGINT AS overlap, (count(DISTINCT canonical_class) FILTER (split_role = 'train')) = 4 AND (count(DISTINCT canonical_class) FILTER (split_role = 'held_out')) = 4 AS class_complete, count(*) FILTER (acquisition_id NOT IN (SELECT acquisition_id FROM features)) AS unknown, (count(DISTINCT canonical_class) FILTER (split_role = 'train')) = 4 AND (count(DISTINCT canonical_class) FILTER (split_role = 'held_out')) = 4 AND count(*) = 8 AND count(*) FILTER (acquisition_id NOT IN (SELECT acquisition_id FROM features)) = 0 AS ok FROM views GROUP BY block, view_id", views=_VIEWS)
def validate_views(spark, d):
    return sp.validate_views(_views(spark, d), ad.features(spark, d), 4, 4)


@query("SELECT c_custkey, c_nationkey, split_role FROM cust_split", views=_VIEWS)
def group_split(spark, d):
    return _split(spark, d).select("c_custkey", "c_nationkey", "split_role")


@query("SELECT o_orderkey, CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.6 + 0.2::DOUBLE THEN 'validation' ELSE 'test' END AS split_role FROM (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('s2|' || o_orderkey), o_orderkey) - 1)::DOUBLE / count(*) OVER (PARTITION BY o_orderstatus) AS p FROM orders)")
def stratified_split(spark, d):
    return sp.stratified_split(ad.table(spark, d, "orders"), "o_orderstatus", "o_orderkey", "s2").select("o_orderkey", "split_role")


@query("SELECT unnest(['c_nationkey', 'c_custkey', 'acctbal']) AS column_name, unnest([count(c_nationkey) = count(*) AND count(DISTINCT c_nationkey) BETWEEN 2 AND count(*) - 1, false, false]) AS valid FROM customer")
def valid_group_columns(spark, d):
    c = ad.table(spark, d, "customer").withColumn("acctbal", F.when(F.col("c_custkey") > 5, F.col("c_acctbal")))
    return sp.valid_group_columns(c, ["c_nationkey", "c_custkey", "acctbal"])


@query("SELECT a AS role_a, b AS role_b, (SELECT count(*) FROM (SELECT c_mktsegment FROM cust_split WHERE split_role = a INTERSECT SELECT c_mktsegment FROM cust_split WHERE split_role = b)) AS overlap FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) t(a, b)", views=_VIEWS)
def group_disjointness(spark, d):
    return sp.group_disjointness(_split(spark, d), "c_mktsegment", ["train", "validation", "test"])


@query("SELECT split_role, c_mktsegment, count(*) AS rows, count(DISTINCT c_nationkey) AS groups FROM cust_split GROUP BY GROUPING SETS ((split_role, c_mktsegment), (split_role))", views=_VIEWS)
def partition_profile(spark, d):
    return sp.partition_profile(_split(spark, d), "c_nationkey", "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN split_role ELSE 'unassigned' END AS split_role FROM cust_split", views=_VIEWS)
def split_role(spark, d):
    roles = _split(spark, d).where("c_nationkey < 20").select("c_custkey", "split_role")
    return sp.tag_role(ad.table(spark, d, "customer"), roles, "c_custkey").select("c_custkey", "split_role")


@query(f"SELECT block, view_id, split_role, count(*) AS n, string_agg(lpad(acquisition_id::VARCHAR, 8, '0') || ':' || lpad(window_order::VARCHAR, 6, '0'), ',' ORDER BY lpad(acquisition_id::VARCHAR, 8, '0') || ':' || lpad(window_order::VARCHAR, 6, '0')) AS window_ids FROM view_windows WHERE canonical_class = '{BASELINE}' GROUP BY ALL", views=_VIEWS)
def reference_source_catalog(spark, d):
    v = _views(spark, d).join(ad.features(spark, d).select("acquisition_id", "window_order"), "acquisition_id")
    return sp.reference_catalog(v, BASELINE)


@query("SELECT c_custkey, ('0x' || substr(sha256('p1|' || c_custkey || '|lr|7'), 1, 8))::BIGINT AS seed FROM customer")
def derive_seed(spark, d):
    return ad.table(spark, d, "customer").select("c_custkey", sp.derive_seed(F.lit("p1"), "c_custkey", F.lit("lr"), F.lit("7")).alias("seed"))


_GRID = {"grid": "SELECT n_name, r_name, m AS model, n_name || '__' || r_name || '__' || m AS unit_id, 'NEVER_STARTED' AS status FROM nation, region, (VALUES ('lr'), ('rf')) t(m)"}


def _grid(spark, d):
    models = ad.table(spark, d, "region").select(F.explode(F.array(F.lit("lr"), F.lit("rf"))).alias("model")).distinct()
    return sp.execution_grid([ad.table(spark, d, "nation").select("n_name"), ad.table(spark, d, "region").select("r_name"), models])


@query("SELECT * FROM grid", views=_GRID)
def execution_grid(spark, d):
    return _grid(spark, d)


@query("SELECT unit_id FROM grid WHERE model <> 'lr' OR r_name = 'ASIA'", views=_GRID)
def resume_plan(spark, d):
    g = _grid(spark, d)
    done = g.where("model = 'lr'").select("unit_id", F.lit("h").alias("expected_hash"), F.when(F.col("r_name") == "ASIA", "other").otherwise("h").alias("stored_hash"), F.lit(1).alias("expected_rows"), F.lit(1).alias("stored_rows"))
    return sp.resume_plan(g, done).select("unit_id")


@query("SELECT block, view_id, string_agg(acquisition_id::VARCHAR, '|' ORDER BY acquisition_id) FILTER (split_role = 'train') AS training, string_agg(acquisition_id::VARCHAR, '|' ORDER BY acquisition_id) FILTER (split_role = 'held_out') AS held_out, count(*) FILTER (split_role = 'train') AS training_n, count(*) FILTER (split_role = 'held_out') AS held_out_n FROM views GROUP BY block, view_id", views=_VIEWS)
def assignment_summary(spark, d):
    return sp.assignment_summary(_views(spark, d))


@query("SELECT c_custkey, split_role, 'GROUPED_BY_c_nationkey' AS limitation FROM cust_split", views=_VIEWS)
def leakage_safe_split(spark, d):
    c = ad.table(spark, d, "customer")
    return sp.leakage_safe_split(c, "c_mktsegment", "c_custkey", ["c_custkey", "c_nationkey"], "s1").select("c_custkey", "split_role", "limitation")
