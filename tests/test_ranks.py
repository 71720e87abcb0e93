"""Ranks, medians, covariances and set overlaps against plain versions, with ties, a dominating group and nulls."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import deviation as de, metrics as me, ml, ranks


def test_cumulative_of_a_dominating_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [("hot", 0.5)] * 500 + [(None, float(v)) for v in rng.integers(0, 5, 200)] + [("b", float("inf")), ("b", -1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {(r["g"], r["v"]): (r["upto"], r["total"]) for r in ranks.cumulative(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v").collect()}
    for g in ("hot", None, "b"):
        v = np.sort([x for k, x in rows if k == g])
        assert all(got[g, x] == (np.searchsorted(v, x, "right"), len(v)) for x in v)
    assert len(got) == len(set(rows))
    steps = {(r["component"], r["value"]): r["cumulative"] for r in me.component_ecdf(df.select(F.col("g").alias("component"), F.col("v").alias("value"))).collect()}
    assert all(steps[k] == n / total for k, (n, total) in got.items())


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_medians_are_exact(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), rng.integers(0, 3, n).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y, strict=True)] + [(None, None, None)], "x double, y double, z double").repartition(5)
    got = {r["name"]: r["median"] for r in ranks.medians(df, {c: F.col(c) for c in "xyz"}).collect()}
    assert got == {"x": pytest.approx(np.median(x), abs=1e-15), "y": np.median(y)}
    filled = ml.impute_train(df.withColumn("split_role", F.lit("train")), ["x", "z"], "median").where("y IS NULL").first()
    assert filled["x"] == pytest.approx(np.median(x), abs=1e-15) and filled["z"] == 0.0


def test_ranks_are_spread_over_ranges(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"), F.lit(1).alias("n"))
    plan = ranks.cumulative(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "SinglePartition" not in plan
    per = ranks.stored(df.repartitionByRange("g", "v").withColumn("r", F.spark_partition_id()), "t").groupBy("r").count().collect()
    assert len(per) >= 1 and sum(r["count"] for r in per) == 20_000


def plain_shrunk(z: np.ndarray) -> np.ndarray:
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum()
    b2 = max(0.0, min((np.mean((z**2).sum(1) ** 2) - (s**2).sum()) / n, d2))
    a = b2 / d2 if d2 > 0 else 0.0
    return a * mu * np.eye(p) + (1 - a) * s


def test_covariance_of_many_features(spark):
    rng = np.random.default_rng(2)
    p, n = 28, 300
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + rng.normal(size=p)
    x[:, 3] = 5.0  # no spread
    rows = [("v1" if k % 3 else None, "train" if k % 5 else "held_out", v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "view string, split_role string, x array<double>").repartition(4)
    got = np.zeros((p, p))
    for r in de.fit_covariance(df.where("view IS NOT NULL"), ["view"]).collect():
        got[r["i"], r["j"]] = r["cov"]
    t = np.array([v for w, role, v in rows if w == "v1" and role == "train"])
    scale = t.std(0)
    z = (t - t.mean(0)) / np.where(scale > 1e-12, scale, 1.0)
    assert np.allclose(got, plain_shrunk(z), atol=1e-9)


def test_jaccard_of_groups_that_share_nothing(spark):
    sets = {1: {"a", "b"}, 2: {"b", "c", "d"}, 3: {"x"}, 4: {"a", "b"}}
    df = spark.createDataFrame([(g, f) for g, s in sets.items() for f in s] + [(1, "a")], "view_id int, feature string")
    got = {(r["a"], r["b"]): r["jaccard"] for r in ml.pairwise_jaccard(df, blocks=3).collect()}
    assert got == {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items()}
    assert "Cartesian" not in (plan := ml.pairwise_jaccard(df)._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
