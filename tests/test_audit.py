"""Canonical JSON, hashes that tell apart, chains of any length, and verification from the event itself."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import Row, functions as F, types as T

from gaugeflow.functions.canonical import canonical_json
from gaugeflow.functions.columns import content_hash
from gaugeflow.operators import audit as au
from gaugeflow.streaming import online as on

TEXTS = ["", "plain", 'say "x" \\ y', "a|b", "é ✓ \U0001f600 ÿ\x7f", "".join(map(chr, range(32))), "back\\u000Bslash \x0b\\\x1f", None]


def dumped(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def test_canonical_json_of_nested_values(spark):
    kind = T._parse_datatype_string("z string, b boolean, n long, m map<string,array<string>>, a array<struct<y:int,x:string>>, d double")
    rows = [(t, None if t is None else len(t) > 3, k, {"ü": [t, None], "b": [], "a|": None} if t != "" else None, [(k, t), None] if t else [], k / 4) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, kind)
    got = [r[0] for r in df.coalesce(1).select(canonical_json(F.struct(*df.columns), kind)).collect()]
    plain = lambda v: {f: plain(x) for f, x in v.asDict().items()} if isinstance(v, Row) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
    assert got == [dumped(plain(r)) for r in df.coalesce(1).collect()]


def test_content_hash_tells_parts_apart(spark):
    parts = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("x", None), ("a\\", "b"), ("a\\|b", ""), ("a", "\\b"), ("\\0", "x")]
    df = spark.createDataFrame(parts, "a string, b string")
    assert len({r[0] for r in df.select(content_hash("a", "b")).collect()}) == len(parts)


def event_rows(spark, runs: int = 3, events: int = 4):
    rows = [(f"run{r}", k, f"TYPE|{k}", TEXTS[(r + k) % len(TEXTS)], ["S1", None, "é"], {"b": 0.25, "a": 1.5e-9}, 0.1 * k) for r in range(runs) for k in range(events)]
    return spark.createDataFrame(rows, "run_id string, event_index int, event_type string, decision_reason string, candidate_states array<string>, class_probabilities map<string,double>, confidence double")


def test_events_verify_from_their_own_fields(spark):
    e = au.audit_events(event_rows(spark))
    runs = e.select("run_id").distinct()
    assert e.columns == list(au.EVENT_FIELDS) and all(r["valid"] and r["events"] == 4 for r in au.verify_chain(e, runs).collect())
    first = e.where("run_id = 'run0' AND event_index = 1").first().asDict(recursive=True)
    told = {k: v for k, v in first.items() if k != "event_hash"}
    assert first["previous_event_hash"] is None and first["event_hash"] == hashlib.sha256(dumped(told).replace("1.5e-09", "1.5E-9").encode()).hexdigest()
    # A run for each field, whose third event has another value there; a link, a run and an index fail as such.
    runs = spark.createDataFrame([(f,) for f in au.EVENT_FIELDS], "run_id string")
    rows = event_rows(spark, 1).drop("run_id").crossJoin(runs)
    e = au.audit_events(rows)
    other = {"class_probabilities": F.create_map(F.lit("b"), F.lit(0.25)), "candidate_states": F.array(F.lit("S1"), F.lit("null"), F.lit("é")), "confidence": F.col("confidence") + 1e-13, "schema_version": F.lit(None).cast("string"), "event_index": F.lit(7).cast("long")}
    spoilt = e.select([F.when((F.col("run_id") == f) & (F.col("event_index") == 3), other.get(f, F.concat(F.coalesce(f, F.lit("")), F.lit("~")))).otherwise(F.col(f)).alias(f) for f in au.EVENT_FIELDS])
    got = {r["run_id"]: (r["valid"], r["first_bad"], r["reason"]) for r in au.verify_chain(spoilt, runs).collect()}
    lost = (False, 4, "MISSING_OR_NONSEQUENTIAL_EVENT")
    expected = {f: (False, 3, "PREVIOUS_HASH_MISMATCH" if f == "previous_event_hash" else "EVENT_HASH_MISMATCH") for f in au.EVENT_FIELDS} | {"run_id": lost, "event_index": lost}
    assert got == expected


def test_a_log_of_lines_verifies(spark, tmp_path):
    """Lines as other writers of canonical JSON leave them: numbers in their own spelling, fields of their own."""
    lines, last = [], None
    for k in range(1, 5):
        event = {"run_id": "r", "event_index": k, "event_id": f"r:{k}", "previous_event_hash": last, "ood_score": 1e-05 * k, "note": TEXTS[k], "state_facts": {"z": 1e16, "a": [True, None]}}
        last = hashlib.sha256(dumped(event).encode()).hexdigest()
        lines.append(dumped(event | {"event_hash": last}))
    run = spark.createDataFrame([("r",), ("none",)], "run_id string")

    def verdict(found):
        df = au.verify_chain(au.parse_lines(spark.createDataFrame([(x,) for x in found], "value string")), run)
        return {r["run_id"]: (r["valid"], r["events"], r["first_bad"], r["reason"]) for r in df.collect()}

    assert verdict([*lines, " ", ""]) == {"r": (True, 4, None, None), "none": (False, 0, None, "EMPTY_AUDIT_LOG")}
    assert verdict([lines[0], lines[1].replace("2e-05", "3e-05"), *lines[2:]])["r"] == (False, 4, 2, "EVENT_HASH_MISMATCH")
    assert verdict([lines[0], *lines[2:]])["r"] == (False, 3, 3, "MISSING_OR_NONSEQUENTIAL_EVENT")
    assert verdict([lines[0], lines[1], lines[1], *lines[2:]])["r"] == (False, 5, 2, "MISSING_OR_NONSEQUENTIAL_EVENT")
    own = au.audit_events(event_rows(spark))
    parsed = au.parse_lines(au.event_lines(own))
    assert all(r["valid"] for r in au.verify_chain(parsed, own.select("run_id")).collect()) and parsed.count() == 12


def test_a_chain_longer_than_a_batch(spark):
    """One run of 150,000 events beside short ones, the same hashes as a plain fold."""
    n = 150_000
    df = spark.range(n + 20).select(F.when(F.col("id") < n, -1).otherwise(F.col("id") % 3).alias("run_id"), F.col("id").alias("event_index"), F.sha2(F.col("id").cast("string"), 224).alias("payload"))
    got = {(r["run_id"], r["event_index"]): r["event_hash"] for r in au.build_chain(df.repartition(8)).where("event_index % 1000 >= 980").collect()}
    last: dict = {}
    for k in range(n + 20):
        run = -1 if k < n else k % 3
        last[run] = hashlib.sha256(f"{last.get(run, '')}|{k}|{hashlib.sha224(str(k).encode()).hexdigest()}".encode()).hexdigest()
        if k % 1000 >= 980:
            assert got[run, k] == last[run]


def test_streamed_events_go_on_and_verify(spark, tmp_path):
    """Two runs of the stream with one checkpoint: the second goes on from the first's hashes."""
    rows = event_rows(spark, 3, 6).select("run_id", "event_index", "event_type", "decision_reason")
    for part, where in enumerate(("event_index < 2", "event_index >= 2")):
        rows.where(where).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = on.read_stream(spark, rows, f"{tmp_path}/in")
        on.append_events(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out")
        assert got.count() == (6, 18)[part] and all(r["valid"] for r in au.verify_chain(got, rows.select("run_id")).collect())
    same = au.audit_events(rows).select("event_id", "event_hash").collect()
    assert {tuple(r) for r in got.select("event_id", "event_hash").collect()} == {tuple(r) for r in same}


@pytest.mark.parametrize("table", ["chain", "events"])
def test_empty_logs(spark, table):
    df = au.build_chain(spark.createDataFrame([], "run_id long, event_index long, payload string")) if table == "chain" else au.audit_events(event_rows(spark).where("false"))
    runs = spark.createDataFrame([(1,)], "run_id long") if table == "chain" else spark.createDataFrame([("1",)], "run_id string")
    r = au.verify_chain(df, runs).first()
    assert (r["valid"], r["events"], r["reason"]) == (False, 0, "EMPTY_AUDIT_LOG")
