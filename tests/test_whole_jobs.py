"""Whole jobs on tables unlike the given ones: folders of part files, short series, values that come out differently when made again."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import gaugeflow.queries as library
import pytest
from conftest import DATA
from gaugeflow.operators import audit as au, deviation as de, ml, policy as po
from gaugeflow.queries import audits, files, learning, risks
from gaugeflow.streaming.online import Prefixes
from oracle import TABLES, both
from pyspark.sql import functions as F


def _against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        if (path := folder / f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got, want = both(spark, con, library.queries()[name], library.oracle_sql()[name], folder)
    assert got and got == want


@pytest.mark.parametrize("name", ["append_audit", "append_events", "stream_windows"])
def test_streams_of_tables_in_parts(spark, tmp_path, name):
    for t in ("conversations", "events"):
        spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    _against_sql(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["order_guard", "validate_order"])
def test_acquisitions_of_few_windows(spark, tmp_path, name):
    """Users with one to seven windows, of each remainder that a fault is given by."""
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").limit(0)
    rows = spark.range(77).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0), (F.col("id") / 11).cast("int") * 8 + 8)).alias("k"))
    made = {"event_id": F.col("user_id") * 100 + F.col("k"), "ts": F.timestamp_seconds(F.col("k")), "value": F.col("k") % 7 + 0.5, "props": F.lit('{"k": 3}'), "event_type": F.lit("view"), "user_id": F.col("user_id")}
    rows.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in e.schema]).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    _against_sql(spark, tmp_path, name)


def test_deviation_keeps_rows_whose_distance_changes(spark):
    draw = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    rows = spark.range(500).select(F.lit(0).alias("view_id"), F.when(F.col("id") % 2 == 0, "train").otherwise("held_out").alias("split_role"), draw().alias("d2"))
    got = de.score_distribution(de.deviation_score(rows, ["view_id"]), ["view_id"]).first()
    assert got["n"] == 500


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_deal_no_rows_by_feature(spark):
    """Two features: a join that deals rows by feature has two tasks, however many rows there are."""
    x, c = learning._xs(spark, f"{DATA}/sf0.001"), learning._coefs(spark)
    scored = ml.linear_scores(x, c, ["case_id"])
    assert "SortMergeJoin [feature" not in _plan(scored)
    plan = _plan(ml.local_contributions(x, c, ["case_id"], scored))
    assert "SortMergeJoin [class" not in plan and "SortMergeJoin [feature" not in plan


def test_flat_transitions_deal_no_rows_by_state(spark):
    """Ten states; the wide columns of one come after the sorts."""
    plan = _plan(au.flatten_transitions(audits._steps(spark, f"{DATA}/sf0.001"), "case_id", po.matrix_table(spark)))
    assert "SortMergeJoin [current_state" not in plan
    assert plan.index("BroadcastHashJoin [current_state") < plan.index("Window [")


def test_fits_of_several_lengths_at_once():
    """A batch of windows is fitted in one go, each length as if it were alone."""
    rng, held, alone = np.random.default_rng(3), Prefixes(0, 0, 0.0, np.zeros((0, 5))), []
    for k in range(40):
        held.add(float(rng.normal()))
        if k >= 3:
            alone.append(held.fit(0.0))
    assert np.allclose(held.fits(list(range(4, 41)), 0.0), alone, rtol=1e-12, atol=1e-12)


def test_cases_and_bundles_share_their_evidence(spark, monkeypatch):
    calls, made = [], risks._evidence
    monkeypatch.setattr(risks, "_evidence", lambda *a: calls.append(a) or made(*a))
    library.queries()["resolve_cases"](spark, f"{DATA}/sf0.001")
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["scan_signal_text", "scan_json_docs"])
def test_files_are_fewer_than_acquisitions(spark, tmp_path, monkeypatch, name):
    """150 acquisitions with ids far apart; some samples lack a value."""
    e = spark.read.parquet(f"{DATA}/sf0.01/events.parquet")
    lost = (F.col("event_id") % 50 == 0) & F.lit(name == "scan_signal_text")
    e.withColumns({"user_id": F.col("user_id") * 1_000_003, "value": F.when(~lost, F.col("value"))}).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(files, "DOCS_A_FILE", 40, raising=False)
    monkeypatch.setattr(files, "shared_folder", lambda spark, part: f"file://{tmp_path}/{part}")
    _against_sql(spark, tmp_path, name)
    assert len({p for k in ("signals", "docs") for p in tmp_path.glob(f"{k}/**/part-*")}) <= 8


def test_scored_windows_are_assembled_in_order(spark):
    """Each acquisition's windows stand in order with probabilities and a sorted provenance; one has no score, one no provenance of its own."""
    rows = [(0, a, w, "held_out", [0.25, 0.75], "b", f"h{a}{w}", None if w == 5 else {"z_own": str(w), "prediction_hash": "old"}) for a in (1, 2) for w in (10, 5, 9, 2)]
    p = spark.createDataFrame(rows, "view_id int, acquisition_id int, window_order int, split_role string, p array<double>, predicted_class string, prediction_hash string, provenance map<string,string>").repartition(4)
    scores = spark.createDataFrame([(0, a, w, w / 20, f"s{w}", "r0") for *_, a, w in [r[:3] for r in rows] if (a, w) != (2, 9)], "view_id int, acquisition_id int, window_order int, deviation double, score_hash string, scorer_hash string")
    inputs, lost = risks.rk.attach_scores(p, scores, ["view_id", "acquisition_id", "window_order"], ["a", "b"])
    got = {r["acquisition_id"]: r for r in inputs.withColumn("names", F.transform("windows", lambda w: F.map_keys(w["provenance"]))).collect()}
    assert [w["window_order"] for w in got[1]["windows"]] == [2, 5, 9, 10] and [w["window_order"] for w in got[2]["windows"]] == [2, 5, 10]
    for a, r in got.items():
        for w, names in zip(r["windows"], r["names"], strict=True):
            k = w["window_order"]
            about = {"prediction_hash": f"h{a}{k}", "deviation_score_hash": f"s{k}", "deviation_scorer_hash": "r0", "source_partition": "held_out"} | risks.rk.SCORE_PROVENANCE | ({"z_own": str(k)} if k != 5 else {})
            assert (r["class_order"], w["probabilities"], w["predicted_class"], w["ood_score"], w["prediction_hash"]) == (["a", "b"], [0.25, 0.75], "b", k / 20, f"h{a}{k}")
            assert w["provenance"] == about and names == sorted(about)
    assert [(r["acquisition_id"], r["window_order"]) for r in lost.collect()] == [(2, 9)]


def test_attached_scores_are_counted_in_what_is_assembled(spark, monkeypatch):
    made, kept = [], risks.stored
    monkeypatch.setattr(risks, "stored", lambda df, name: made.append((name, kept(df, name))) or made[-1][1])
    counts = {r["split_role"]: r["joined"] for r in library.queries()["attach_scores"](spark, f"{DATA}/sf0.001").collect()}
    made = dict(made)
    held = {(r["view_id"], r["acquisition_id"], r["window_order"]): r for r in made["predictions"].where("split_role = 'held_out'").collect()}
    windows = [((r["view_id"], r["acquisition_id"], w["window_order"]), w) for r in made["inputs"].collect() for w in r["windows"]]
    assert held and sorted(k for k, _ in windows) == sorted(held) and counts["held_out"] == len(held)
    assert all(w["probabilities"] == held[k]["p"] and w["provenance"]["prediction_hash"] == held[k]["prediction_hash"] and 0 < w["ood_score"] <= 1 for k, w in windows)
    assert len({w["provenance"]["deviation_scorer_hash"] for _, w in windows}) == 2 and all(len(w["provenance"]) == 10 for _, w in windows)


def test_bundles_compute_their_risk_once(spark):
    """The safety part is taken of the same rows as the risk, not joined to them."""
    keys = ["view_id", "acquisition_id"]
    acq, trends, windows = risks._evidence(spark, f"{DATA}/sf0.001")
    plan = _plan(risks._bundles(spark, "", (acq, trends, windows)).select("bundle_hash"))
    alone = _plan(risks.rk.combined_risk(risks.rk.risk_components(acq, trends, windows, keys, risks.BASELINE)))
    scans = lambda text: text.count("FileScan parquet")
    assert scans(plan) == scans(alone) + 3  # trends, acquisitions and windows of the bundle itself
