"""Truth tables of the guard rules and of the expert profile, written out by hand: a sound case, and what sets off each rule."""

from __future__ import annotations

import pytest

from gaugeflow.operators import policy as po

SOUND = {
    "case_id": 0, "current_state": "DECISION_CHECK", "proposed_state": "RECOMMENDATION", "allowed": ["RECOMMENDATION", "ESCALATION", "NO_DECISION"],
    "confidence": 0.9, "data_quality": 0.9, "missing_ratio": 0.01, "risk_score": 0.2, "ood_score": 0.1, "explanation_score": 0.9,
    "representation_disagreement": 0.1, "classifier_disagreement": 0.1, "domain_consistency_score": 0.9, "input_available": True,
    "validation_passed": True, "audit_available": True, "audit_chain_valid": True, "conflict": False, "explanation_required": True,
    "explanation_available": True, "spline_fit_valid": True, "model_artifact_valid": True, "diagnosis": "Healthy", "reason": "x",
    "action_code": "CONTINUE_MONITORING", "path_end": "DECISION_CHECK",
}
#: (facts that differ, guard rules, profile rules, final state)
CASES = [
    ({}, "", "", "RECOMMENDATION"),
    ({"input_available": False}, "R1", "R1", "NO_DECISION"),
    ({"validation_passed": None}, "R2", "", "NO_DECISION"),
    ({"confidence": None}, "R3", "", "NO_DECISION"),
    ({"audit_available": False}, "R4", "R14", "NO_DECISION"),
    ({"conflict": True}, "R5", "R6", "ESCALATION"),
    ({"data_quality": 0.74}, "R6", "R2", "NO_DECISION"),
    ({"data_quality": 0.75, "missing_ratio": 0.10}, "", "", "RECOMMENDATION"),
    ({"missing_ratio": 0.11}, "R6", "R2", "NO_DECISION"),
    ({"path_end": "EXPLANATION_GENERATION"}, "R7", "", "NO_DECISION"),
    ({"reason": None}, "R8", "", "NO_DECISION"),
    ({"risk_score": 0.61}, "R9", "R11", "ESCALATION"),
    ({"risk_score": 0.60}, "", "", "RECOMMENDATION"),
    ({"risk_score": 0.61, "action_code": "OTHER"}, "", "R11", "RECOMMENDATION"),
    ({"ood_score": 0.51}, "R10", "R13", "ESCALATION"),
    ({"explanation_score": 0.69}, "R11", "R9", "ESCALATION"),
    ({"explanation_available": False}, "R11", "R9", "ESCALATION"),
    ({"explanation_available": False, "explanation_required": False}, "", "", "RECOMMENDATION"),
    ({"allowed": ["ESCALATION", "NO_DECISION"]}, "R12", "R16", "DECISION_CHECK"),
    ({"spline_fit_valid": False}, "R13", "R3", "NO_DECISION"),
    ({"model_artifact_valid": False}, "R14", "R4", "NO_DECISION"),
    ({"confidence": 0.69}, "R15", "R5", "ESCALATION"),
    ({"representation_disagreement": 0.36}, "R16", "R7", "ESCALATION"),
    ({"classifier_disagreement": 0.36}, "R17", "R8", "ESCALATION"),
    ({"domain_consistency_score": 0.59}, "R18", "R10", "ESCALATION"),
    ({"diagnosis": "Mech_Elec_Damage"}, "R19", "R12", "ESCALATION"),
    ({"audit_chain_valid": False}, "R20", "R15", "NO_DECISION"),
    ({"conflict": True, "input_available": False, "audit_chain_valid": False}, "R1 R5 R20", "R1 R6 R15", "NO_DECISION"),
]


@pytest.fixture(scope="module")
def cases(spark):
    kinds = {"case_id": "int", "current_state": "string", "proposed_state": "string", "allowed": "array<string>", **po.FACTS}
    rows = [tuple({**SOUND, **change, "case_id": k}[c] for c in kinds) for k, (change, *_) in enumerate(CASES)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def _short(ids: str) -> str:
    return " ".join(i.split("_")[0] for i in ids.split(";") if i)


def test_rules_and_outcomes(cases):
    got = {r["case_id"]: r for r in po.guard_outcome(po.guard_results(cases)).collect()}
    for k, (change, guard, _, final) in enumerate(CASES):
        assert (" ".join(t["rule_id"].split("_")[0] for t in got[k]["triggered"]), got[k]["final_state"]) == (guard, final), change
    assert got[len(CASES) - 1]["dominant_action"] == "FAIL_CLOSED"


def test_expert_profile(cases):
    got = {r["case_id"]: _short(r["fired"]) for r in po.rule_profile(cases).collect()}
    assert got == {k: profile for k, (_, _, profile, _) in enumerate(CASES)}


def test_thresholds_are_apart(cases):
    strict = po.THRESHOLDS | {"max_classifier_disagreement": 0.05}
    got = {r["case_id"]: [t["rule_id"].split("_")[0] for t in r["triggered"]] for r in po.guard_results(cases, thresholds=strict).collect()}
    assert got[0] == ["R17"]


def test_a_rule_without_a_readable_fact_fails_closed(cases):
    text = cases.where("case_id = 0").withColumn("risk_score", cases["risk_score"].cast("string")).drop("ood_score").selectExpr("*", "'?' AS ood_score")
    r = po.guard_outcome(po.guard_results(text)).first()
    assert (r["dominant_rule"], r["dominant_action"], r["final_state"]) == ("R10_OOD_ESCALATE_OR_REJECT_ERROR", "FAIL_CLOSED", "NO_DECISION")
    assert [t["rule_id"] for t in r["triggered"]] == ["R10_OOD_ESCALATE_OR_REJECT_ERROR"]
