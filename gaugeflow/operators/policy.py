"""Rules and transition policies over whole case tables: a row a case, or a row a case and step.

Rules are data: a table of (rule_id, action, forced state, condition), the condition being SQL text over the case's columns
`current_state`, `proposed_state`, `allowed` and its facts. All rules of a case are evaluated in one narrow projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import clamp, normalized_entropy
from ..plans.dealing import dealt
from ..schemas import CLASSES

# States in order, the forward edges of each in the declared order, and the static probabilities.
STATES = ("DATA_ACQUISITION", "DATA_VALIDATION", "FEATURE_EXTRACTION", "SPLINE_MODELLING", "DIAGNOSTIC_INFERENCE", "EXPLANATION_GENERATION", "DECISION_CHECK", "RECOMMENDATION", "ESCALATION", "NO_DECISION", "AUDIT")
STATIC_MATRIX = {
    "DATA_ACQUISITION": {"DATA_VALIDATION": 1.0},
    "DATA_VALIDATION": {"FEATURE_EXTRACTION": 0.82, "DATA_ACQUISITION": 0.08, "NO_DECISION": 0.10},
    "FEATURE_EXTRACTION": {"SPLINE_MODELLING": 0.90, "NO_DECISION": 0.10},
    "SPLINE_MODELLING": {"DIAGNOSTIC_INFERENCE": 0.78, "ESCALATION": 0.12, "NO_DECISION": 0.10},
    "DIAGNOSTIC_INFERENCE": {"EXPLANATION_GENERATION": 0.86, "ESCALATION": 0.14},
    "EXPLANATION_GENERATION": {"DECISION_CHECK": 0.80, "ESCALATION": 0.12, "NO_DECISION": 0.08},
    "DECISION_CHECK": {"RECOMMENDATION": 0.74, "ESCALATION": 0.16, "NO_DECISION": 0.10},
    "RECOMMENDATION": {"AUDIT": 1.0},
    "ESCALATION": {"AUDIT": 1.0},
    "NO_DECISION": {"AUDIT": 1.0},
}
TERMINAL = ("RECOMMENDATION", "ESCALATION", "NO_DECISION")

# Thresholds of the guard and the precedence of its actions.
THRESHOLDS = {"min_data_quality": 0.75, "max_missing_ratio": 0.10, "max_risk_for_auto_recommendation": 0.60, "max_ood_score": 0.50, "min_explanation_score": 0.70, "min_confidence_for_recommendation": 0.70, "max_representation_disagreement": 0.35, "max_classifier_disagreement": 0.35, "min_domain_consistency_score": 0.60}
PRECEDENCE = {"ALLOW": 0, "BLOCK": 10, "FORCE_ESCALATION": 20, "FORCE_NO_DECISION": 30, "FAIL_CLOSED": 40}

_REC = "proposed_state = 'RECOMMENDATION'"
_CAN = "array_contains(allowed, '{}')"
_ND, _ES = "NO_DECISION", "ESCALATION"

# The guard's rules by rising priority. A condition that is null doesn't hold.
GUARD_RULES = (
    ("R1_NO_DIAGNOSIS_WITHOUT_DATA", "FORCE_NO_DECISION", _ND, "NOT coalesce(input_available, false)"),
    ("R2_VALIDATION_REQUIRED", "FORCE_NO_DECISION", _ND, "current_state NOT IN ('DATA_ACQUISITION', 'DATA_VALIDATION') AND NOT coalesce(validation_passed, false)"),
    ("R3_CONFIDENCE_REQUIRED", "FORCE_NO_DECISION", _ND, f"{_REC} AND confidence IS NULL"),
    ("R4_AUDIT_REQUIRED", "FAIL_CLOSED", _ND, f"NOT audit_available AND ({_REC} OR {_CAN.format(_ND)})"),
    ("R5_MODEL_CONFLICT_ESCALATE", "FORCE_ESCALATION", _ES, f"conflict AND ({_REC} OR {_CAN.format(_ES)})"),
    ("R6_POOR_DATA_NO_DECISION", "FORCE_NO_DECISION", _ND, f"(coalesce(data_quality < {{min_data_quality}}, false) OR coalesce(missing_ratio > {{max_missing_ratio}}, false)) AND ({_REC} OR {_CAN.format(_ND)})"),
    ("R7_STATE_PATH_REQUIRED", "FAIL_CLOSED", _ND, "coalesce(path_end, '') <> current_state"),
    ("R8_JUSTIFICATION_REQUIRED", "FORCE_NO_DECISION", _ND, f"{_REC} AND reason IS NULL"),
    ("R9_HIGH_RISK_BLOCK_UNSUPPORTED_AUTO_ACTION", "FORCE_ESCALATION", _ES, f"{_REC} AND risk_score > {{max_risk_for_auto_recommendation}} AND (action_code IS NULL OR action_code IN ('CONTINUE_MONITORING', 'INCREASE_MONITORING_FREQUENCY', 'SCHEDULE_MECHANICAL_INSPECTION', 'INSPECT_ELECTRICAL_CONDITION', 'PLAN_INSPECTION', 'IMMEDIATE_EXPERT_REVIEW'))"),
    ("R10_OOD_ESCALATE_OR_REJECT", "FORCE_ESCALATION", _ES, f"ood_score > {{max_ood_score}} AND {_CAN.format(_ES)}"),
    ("R11_EXPLANATION_REQUIRED", "FORCE_ESCALATION", _ES, f"coalesce(explanation_required, true) AND {_REC} AND (NOT coalesce(explanation_available, false) OR explanation_score IS NULL OR explanation_score < {{min_explanation_score}})"),
    ("R12_INVALID_TRANSITION_REJECT", "BLOCK", None, "NOT array_contains(allowed, proposed_state)"),
    ("R13_INVALID_SPLINE_FIT", "FORCE_NO_DECISION", _ND, f"NOT spline_fit_valid AND {_CAN.format(_ND)}"),
    ("R14_MODEL_ARTIFACT_INVALID", "FORCE_NO_DECISION", _ND, f"NOT model_artifact_valid AND {_CAN.format(_ND)}"),
    ("R15_LOW_CONFIDENCE_ESCALATE", "FORCE_ESCALATION", _ES, f"{_REC} AND confidence < {{min_confidence_for_recommendation}}"),
    ("R16_REPRESENTATION_DISAGREEMENT_ESCALATE", "FORCE_ESCALATION", _ES, f"representation_disagreement > {{max_representation_disagreement}} AND {_CAN.format(_ES)}"),
    ("R17_CLASSIFIER_DISAGREEMENT_ESCALATE", "FORCE_ESCALATION", _ES, f"classifier_disagreement > {{max_classifier_disagreement}} AND {_CAN.format(_ES)}"),
    ("R18_LOW_DOMAIN_CONSISTENCY", "FORCE_ESCALATION", _ES, f"{_REC} AND domain_consistency_score < {{min_domain_consistency_score}}"),
    ("R19_COMBINED_FAULT_EXPERT_REVIEW", "FORCE_ESCALATION", _ES, f"{_REC} AND diagnosis = 'Mech_Elec_Damage'"),
    ("R20_AUDIT_CHAIN_FAILURE", "FAIL_CLOSED", _ND, f"NOT audit_chain_valid AND {_CAN.format(_ND)}"),
)

# The expert profile, rules by rising priority with the outcomes they allow.
PROFILE_RULES = (
    ("R1_NO_INPUT", 10, "NO_DECISION", "NOT input_available"),
    ("R2_POOR_DATA_QUALITY", 20, "NO_DECISION,REQUEST_NEW_DATA", "data_quality < {min_data_quality} OR missing_ratio > {max_missing_ratio}"),
    ("R3_INVALID_SPLINE_FIT", 30, "NO_DECISION,ESCALATION", "NOT spline_fit_valid"),
    ("R4_MODEL_ARTIFACT_INVALID", 40, "NO_DECISION", "NOT model_artifact_valid"),
    ("R5_LOW_CONFIDENCE", 50, "ESCALATION,NO_DECISION", "confidence < {min_confidence_for_recommendation}"),
    ("R6_SPLINE_CLASSIFIER_CONFLICT", 60, "ESCALATION", "conflict"),
    ("R7_REPRESENTATION_DISAGREEMENT", 70, "ESCALATION", "representation_disagreement > {max_representation_disagreement}"),
    ("R8_CLASSIFIER_DISAGREEMENT", 80, "ESCALATION", "classifier_disagreement > {max_classifier_disagreement}"),
    ("R9_MISSING_EXPLANATION", 90, "ESCALATION,NO_DECISION", "coalesce(explanation_required, true) AND (NOT explanation_available OR explanation_score < {min_explanation_score})"),
    ("R10_LOW_DOMAIN_CONSISTENCY", 100, "ESCALATION,NO_DECISION", "domain_consistency_score < {min_domain_consistency_score}"),
    ("R11_HIGH_RISK", 110, "ESCALATION", "risk_score > {max_risk_for_auto_recommendation}"),
    ("R12_COMBINED_FAULT_EXPERT_REVIEW", 120, "ESCALATION", "diagnosis = 'Mech_Elec_Damage'"),
    ("R13_OOD", 130, "ESCALATION,NO_DECISION", "ood_score > {max_ood_score}"),
    ("R14_AUDIT_WRITE_FAILURE", 140, "NO_DECISION", "NOT audit_available"),
    ("R15_AUDIT_CHAIN_FAILURE", 150, "NO_DECISION", "NOT audit_chain_valid"),
    ("R16_INVALID_TRANSITION", 160, "NO_DECISION", "NOT array_contains(allowed, proposed_state)"),
)

FACTS = {
    **dict.fromkeys(("confidence", "data_quality", "missing_ratio", "risk_score", "ood_score", "explanation_score", "representation_disagreement", "classifier_disagreement", "domain_consistency_score"), "double"),
    **dict.fromkeys(("input_available", "validation_passed", "audit_available", "audit_chain_valid", "conflict", "explanation_required", "explanation_available", "spline_fit_valid", "model_artifact_valid"), "boolean"),
    **dict.fromkeys(("diagnosis", "reason", "action_code", "path_end"), "string"),
}


def with_facts(cases: DataFrame) -> DataFrame:
    """The cases with every fact as a column of its type: null where they lack it, or where it is a text that doesn't parse."""
    lacking = {f: F.lit(None).cast(t) for f, t in FACTS.items() if f not in cases.columns}
    texts = {f: F.col(f).try_cast(t) for f, t in FACTS.items() if _is_text(cases, f) and t != "string"}
    return cases.withColumns(lacking | texts)


def _is_text(cases: DataFrame, fact: str) -> bool:
    return fact in cases.columns and cases.schema[fact].dataType.simpleString() == "string"


def _condition(text: str, thresholds: dict[str, float]) -> str:
    return f"coalesce({text.format(**thresholds)}, false)"


def guard_results(cases: DataFrame, rules=GUARD_RULES, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """The cases with `triggered`, an array of (precedence, priority, rule_id, action, forced) of the rules that hold.

    A rule fails closed, as `<rule>_ERROR`, where a fact that it reads is given as a text that doesn't parse.
    """
    parse = {f: F.col(f).isNotNull() & F.col(f).try_cast(t).isNull() for f, t in FACTS.items() if _is_text(cases, f) and t != "string"}
    broken = cases.withColumns({f"_broken_{f}": c for f, c in parse.items()})

    def result(k: int, rule: str, action: str, forced: str | None) -> Column:
        return F.struct(F.lit(PRECEDENCE[action]).alias("precedence"), F.lit(k).alias("priority"), F.lit(rule).alias("rule_id"), F.lit(action).alias("action"), F.lit(forced).cast("string").alias("forced"))

    results = []
    for k, (rule, action, forced, text) in enumerate(rules, 1):
        hit = F.when(F.expr(_condition(text, thresholds)), result(k, rule, action, forced))
        unread = [F.col(f"_broken_{f}") for f in parse if re.search(rf"\b{f}\b", text.format(**dict.fromkeys(thresholds, 0)))]
        results.append(F.when(reduce(lambda a, b: a | b, unread), result(k, f"{rule}_ERROR", "FAIL_CLOSED", _ND)).otherwise(hit) if unread else hit)
    return with_facts(broken).withColumn("triggered", F.array_compact(F.array(*results))).drop(*[f"_broken_{f}" for f in parse])


def guard_outcome(results: DataFrame) -> DataFrame:
    """Results with the dominant rule and action, the final state and whether the proposal was overridden.

    The highest precedence wins, then the higher priority. BLOCK stays in the current state; without a rule the proposal holds.
    """
    top = F.array_max("triggered")
    out = results.withColumn("_top", top)
    out = out.withColumn("dominant_rule", F.col("_top.rule_id")).withColumn("dominant_action", F.coalesce(F.col("_top.action"), F.lit("ALLOW")))
    final = F.when(F.col("_top").isNull(), F.col("proposed_state")).otherwise(F.coalesce(F.col("_top.forced"), F.col("current_state")))
    return out.withColumn("final_state", final).withColumn("overridden", F.col("_top").isNotNull()).drop("_top")


def rule_profile(cases: DataFrame, rules=PROFILE_RULES, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """The cases with `fired`, the ids of the expert rules that hold by priority, and `allowed_outcomes` of the first."""
    hits = F.array_compact(F.array(*[F.when(F.expr(_condition(text, thresholds)), F.struct(F.lit(priority).alias("priority"), F.lit(rule).alias("rule_id"), F.lit(outcomes).alias("outcomes"))) for rule, priority, outcomes, text in rules]))
    out = with_facts(cases).withColumn("_hits", hits)
    return out.withColumn("fired", F.array_join(F.transform("_hits", lambda h: h["rule_id"]), ";")).withColumn("allowed_outcomes", F.coalesce(F.get("_hits", F.lit(0))["outcomes"], F.lit("RECOMMENDATION"))).drop("_hits")


def matrix_table(spark: SparkSession, matrix: dict[str, dict[str, float]] = STATIC_MATRIX) -> DataFrame:
    """(source, target, pos, probability) of a transition matrix."""
    return spark.createDataFrame([(s, t, k, p) for s, row in matrix.items() for k, (t, p) in enumerate(row.items())], "source string, target string, pos int, probability double")


def validate_matrix(matrix: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, total, unknown_targets, missing_targets, ok): rows sum to 1, targets are the declared ones, 0 <= p <= 1."""
    j = matrix.select("source", "target", "probability").join(edges.select("source", "target", F.lit(True).alias("declared")), ["source", "target"], "full_outer")
    g = j.groupBy("source").agg(F.sum("probability").alias("total"), F.count_if(F.col("declared").isNull()).alias("unknown_targets"), F.count_if(F.col("probability").isNull()).alias("missing_targets"), F.bool_and(F.col("probability").between(0.0, 1.0)).alias("_in"))
    return g.withColumn("ok", (F.abs(F.col("total") - 1) <= 1e-9) & (F.col("unknown_targets") == 0) & (F.col("missing_targets") == 0) & F.col("_in")).drop("_in")


def normalize_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(.., probability): score over the sum of its keys' scores; null for negative or non-finite scores and for no mass."""
    w = W.partitionBy(*keys)
    bad = F.max(F.when((F.col("score") < 0) | F.isnan("score") | (F.col("score") == float("inf")) | F.col("score").isNull(), 1).otherwise(0)).over(w)
    total = F.sum("score").over(w)
    return scores.withColumn("probability", F.when((bad == 0) & (total > 0), F.col("score") / total))


def select_state(probabilities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, selected): the most probable target, the earliest declared of equals."""
    return probabilities.groupBy(*keys).agg(F.max_by("target", F.struct(F.round("probability", 12), -F.col("pos"))).alias("selected"))


def sample_state(probabilities: DataFrame, keys: Sequence[str], seed: str) -> DataFrame:
    """(keys, selected): a target drawn by the hash of seed and keys against the running sum of probabilities."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    run = F.sum("probability").over(W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    p = probabilities.withColumn("_u", u).withColumn("_run", F.round(run, 12))
    chosen = F.coalesce(F.min_by(F.when(F.col("_run") > F.col("_u"), F.col("target")), F.when(F.col("_run") > F.col("_u"), F.col("pos"))), F.max_by("target", "pos"))
    return p.groupBy(*keys).agg(chosen.alias("selected"))


# The covariates of the posterior policy as expressions over the facts.
COVARIATES = {
    "data_quality": "coalesce(data_quality, 1.0D)",
    "missing_ratio": "coalesce(missing_ratio, 0.0D)",
    "confidence": "coalesce(confidence, 0.0D)",
    "model_agreement": "coalesce(model_agreement, 0.0D)",
    "risk_score": "coalesce(risk_score, 0.0D)",
    "representation_agreement": "1 - coalesce(representation_disagreement, 0.0D)",
    "classifier_agreement": "1 - coalesce(classifier_disagreement, 0.0D)",
    "ood_score": "coalesce(ood_score, 0.0D)",
    "explanation_score": "coalesce(explanation_score, 0.0D)",
    "domain_consistency_score": "coalesce(domain_consistency_score, 0.0D)",
    "domain_consistency": "coalesce(domain_consistency_score, 0.0D)",
    "distance_from_healthy": "coalesce(distance_from_healthy, 0.0D)",
    "slope": "coalesce(slope, 0.0D)",
    "curvature": "coalesce(curvature, 0.0D)",
    "spline_curvature": "coalesce(spline_curvature, 0.0D)",
}

# Coefficients of the surrogate posterior's centre.
BASE_COEFFICIENTS = {
    "RECOMMENDATION": {"intercept": 0.25, "confidence": 1.20, "risk_score": -2.00, "representation_agreement": 0.75, "classifier_agreement": 0.65, "distance_from_healthy": -0.35, "spline_curvature": -0.20, "ood_score": -2.20, "explanation_score": 0.95, "domain_consistency": 0.80, "missing_ratio": -1.80},
    "ESCALATION": {"intercept": -0.10, "confidence": -0.10, "risk_score": 2.10, "representation_agreement": -1.25, "classifier_agreement": -1.20, "distance_from_healthy": 0.90, "spline_curvature": 0.80, "ood_score": 1.85, "explanation_score": -0.70, "domain_consistency": -0.80, "missing_ratio": 0.60},
    "NO_DECISION": {"intercept": -0.45, "confidence": -1.40, "risk_score": 0.35, "representation_agreement": -0.20, "classifier_agreement": -0.30, "distance_from_healthy": 0.05, "spline_curvature": 0.10, "ood_score": 0.60, "explanation_score": -1.45, "domain_consistency": -0.55, "missing_ratio": 2.40},
}
SAMPLES = 64
MISSING_LOGIT = -20.0


def policy_covariates(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, covariates): every covariate clamped to 0 .. 1, defaults for what isn't known."""
    c = with_facts(cases)
    c = c.withColumns({x: F.lit(None).cast("double") for x in ("distance_from_healthy", "spline_curvature", "model_agreement", "slope", "curvature") if x not in c.columns})
    return c.select(key, *[clamp(F.expr(e)).alias(n) for n, e in COVARIATES.items()])


def surrogate_samples(spark: SparkSession, base: dict[str, dict[str, float]] = BASE_COEFFICIENTS, count: int = SAMPLES) -> DataFrame:
    """(sample_id, state, feature, coef): `count` coefficient sets around the base, spread evenly, later features more."""
    rows = spark.createDataFrame([(s, f, k, c) for s, row in base.items() for k, (f, c) in enumerate(row.items())], "state string, feature string, k int, base double")
    jitter = (F.col("id") - F.lit((count - 1) / 2.0)) / F.lit(count * 40.0)
    return spark.range(count).crossJoin(F.broadcast(rows)).select(F.col("id").alias("sample_id"), "state", "feature", (F.col("base") + jitter * (1 + F.col("k") / 20)).alias("coef"))  # a table of fixed size


#: Sets of coefficients that a task holds, at most.
MOST_SETS = 20_000


def coefficient_sets(samples: DataFrame, states: Sequence[str] = TERMINAL, features: Sequence[str] = tuple(COVARIATES)) -> np.ndarray:
    """Coefficients by sample, state and feature, the intercept first, of a table (sample_id, state, feature, coef).

    A feature that a sample lacks has coefficient 0; a state that a sample lacks has the logit MISSING_LOGIT. The sets are sent
    to every task, so more than MOST_SETS of them are an error.
    """
    names = ["intercept", *features]
    found = samples.where(F.col("state").isin(*states) & F.col("feature").isin(*names))
    if (n := found.agg(F.count_distinct("sample_id").alias("n")).first()["n"]) > MOST_SETS:
        raise ValueError(f"{n} sets of coefficients, at most {MOST_SETS}")
    rows = found.toPandas()
    sets = {k: n for n, k in enumerate(sorted(rows["sample_id"].unique()))}
    out = np.zeros((max(1, len(sets)), len(states), len(names)))
    out[:, :, 0] = MISSING_LOGIT
    at = rows["sample_id"].map(sets).to_numpy(int), rows["state"].map(list(states).index).to_numpy(int)
    out[at[0], at[1], 0] = 0.0
    out[at[0], at[1], rows["feature"].map(names.index).to_numpy(int)] = rows["coef"]
    return out


def posterior_spread(covariates: DataFrame, samples: DataFrame, states: Sequence[str] = TERMINAL, features: Sequence[str] = tuple(COVARIATES), key: str = "case_id") -> DataFrame:
    """(key, state, pos, mean, variance, low, high) of each state's softmax probability over the samples of coefficients.

    The sample variance, and the values at the floor of 2.5 % and the ceiling of 97.5 % of n - 1. All samples of a batch of
    cases are one matrix product; the coefficients have a fixed size (64 sets by default), and no case is shuffled.
    """
    sets = coefficient_sets(samples, states, features)
    n, k = len(sets), len(states)
    ends = int(np.floor((n - 1) * 0.025)), int(np.ceil((n - 1) * 0.975))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 2048) for i in range(0, b.num_rows, 2048)):  # 2048 cases, 64 sets and 3 states are 3 MB
                x = np.column_stack([np.ones(part.num_rows), *[part.column(f).to_numpy(zero_copy_only=False) for f in features]])
                logits = (x @ sets.reshape(n * k, -1).T).reshape(-1, n, k)
                e = np.exp(logits - logits.max(2, keepdims=True))
                p = np.sort(e / e.sum(2, keepdims=True), axis=1)
                figures = [p.mean(1), p.var(1, ddof=1) if n > 1 else np.zeros(p[:, 0].shape), p[:, ends[0]], p[:, ends[1]]]
                keys = part.column(key).take(pa.array(np.repeat(np.arange(part.num_rows), k)))
                names = pa.array(list(states) * part.num_rows)
                yield pa.RecordBatch.from_arrays([keys, names, pa.array(np.tile(np.arange(k, dtype=np.int32), part.num_rows)), *[pa.array(f.ravel()) for f in figures]], [key, "state", "pos", "mean", "variance", "low", "high"])

    rows = covariates.select(key, *[F.col(f).cast("double") for f in features])
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, state string, pos int, mean double, variance double, low double, high double")


def posterior_scores(spread: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, p, selected, entropy, confidence): mean probabilities scaled to sum 1, in the order of the states."""
    g = spread.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "state", "mean", "low", "high"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["mean"])
    g = g.withColumn("p", F.transform("s", lambda x: x["mean"] / total)).withColumn("entropy", normalized_entropy("p"))
    best = F.array_position(F.transform("p", lambda v: F.round(v, 12)), F.round(F.array_max("p"), 12)).cast("int")
    return g.select(key, "p", F.get("s", best - 1)["state"].alias("selected"), "entropy", clamp(1 - F.col("entropy")).alias("confidence"), "s")


def hybrid_blend(static: Sequence[float], posterior: DataFrame, valid: Column, states: Sequence[str] = TERMINAL, high_entropy: float = 0.82, key: str = "case_id") -> DataFrame:
    """(key, p, selected, reason): (1 - w) static + w posterior, w being the confidence where the diagnostics are valid, else 0.

    A high entropy, or intervals of two outcomes that overlap, gives escalation 0.90 and the others 0.05, scaled to sum 1.
    """
    at = {s: k for k, s in enumerate(states)}
    s = lambda name, f: F.get("s", F.lit(at[name]))[f]
    pairs = [(a, b) for i, a in enumerate(states) for b in states[i + 1 :]]
    overlap = F.lit(False)
    for a, b in pairs:
        overlap = overlap | (F.greatest(s(a, "low"), s(b, "low")) <= F.least(s(a, "high"), s(b, "high")))
    reason = F.when(~valid, "INVALID_MCMC_DIAGNOSTICS_STATIC_FALLBACK").when(F.col("entropy") >= high_entropy, "HIGH_POSTERIOR_ENTROPY_ESCALATION").when(overlap, "POSTERIOR_TERMINAL_HDI_OVERLAP_ESCALATION").otherwise("HYBRID_STATIC_BAYESIAN_BLEND")
    w = F.when(valid, F.col("confidence")).otherwise(0.0)
    fixed = F.array(*[F.lit(v) for v in static])
    forced = F.array(*[F.lit(0.90 if x == "ESCALATION" else 0.05) for x in states])
    raw = F.when(F.col("reason").isin("HIGH_POSTERIOR_ENTROPY_ESCALATION", "POSTERIOR_TERMINAL_HDI_OVERLAP_ESCALATION"), forced).otherwise(F.zip_with(fixed, "p", lambda a, b: (1 - F.col("_w")) * a + F.col("_w") * b))
    j = posterior.withColumn("reason", reason).withColumn("_w", w).withColumn("_raw", raw)
    total = F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v)
    j = j.withColumn("p", F.transform("_raw", lambda v: v / total))
    best = F.element_at(F.array(*[F.lit(x) for x in states]), F.array_position(F.transform("p", lambda v: F.round(v, 12)), F.round(F.array_max("p"), 12)).cast("int"))
    return j.select(key, "p", best.alias("selected"), "reason")


def posterior_summary(samples: DataFrame) -> DataFrame:
    """(state, feature, mean, sd, low, high) of the coefficients; each (state, feature) once.

    low and high are the values at the floor of 2.5 % and the ceiling of 97.5 % of n - 1; ranks come of a sort that spills,
    so that no list of values is held in a row.
    """
    keys = ["state", "feature"]
    stats = samples.groupBy(*keys).agg(F.count("coef").alias("n"), F.avg("coef").alias("mean"), F.coalesce(F.stddev_samp("coef"), F.lit(0.0)).alias("sd"))
    ranked = samples.where("coef IS NOT NULL").select(*keys, "coef", (F.row_number().over(W.partitionBy(*keys).orderBy("coef")) - 1).alias("r"))
    low, high = F.floor((F.col("n") - 1) * 0.025), F.ceil((F.col("n") - 1) * 0.975)
    ends = ranked.join(stats, keys).where((F.col("r") == low) | (F.col("r") == high)).groupBy(*keys).agg(F.min("coef").alias("low"), F.max("coef").alias("high"))
    return stats.join(ends, keys).select(*keys, "mean", "sd", "low", "high")


def posterior_to_long(chains: DataFrame, covariates: Sequence[str], states: Sequence[str], draws: int) -> DataFrame:
    """(sample_id, state, feature, coef) from (chain, draw, coef array by covariate and state)."""
    c = chains.select((F.col("chain") * draws + F.col("draw")).alias("sample_id"), F.posexplode("coef").alias("f", "row"))
    c = c.select("sample_id", "f", F.posexplode("row").alias("s", "coef"))
    name = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(k) + 1)
    return c.select("sample_id", name(states, "s").alias("state"), name(covariates, "f").alias("feature"), "coef")


def rule_targets(covariates: DataFrame) -> DataFrame:
    """Rows with `target`: bad data gives no decision; high risk, far from training or little agreement an escalation."""
    bad = (F.col("missing_ratio") > 0.20) | (F.col("data_quality") < 0.70)
    up = (F.col("risk_score") >= 0.75) | (F.col("ood_score") >= 0.78) | (F.col("representation_agreement") < 0.50)
    return covariates.withColumn("target", F.when(bad, "NO_DECISION").when(up, "ESCALATION").otherwise("RECOMMENDATION"))


# Risk, confidence and agreement by class for the derived covariates.
CLASS_RISK = {"Healthy": 0.10, "Mech_Damage": 0.55, "Elec_Damage": 0.55, "Mech_Elec_Damage": 0.90}


def transition_covariates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Covariates of (slope, curvature, distance, missing_ratio, fit_ok, canonical_class, split_role) rows.

    Slope, curvature and distance are scaled by their largest size among the training rows (1 if none or 0).
    """
    parts = ("slope", "curvature", "distance")
    top = rows.where("split_role = 'train'").agg(*[F.max(F.abs(p)).alias(f"_{p}") for p in parts])
    j = rows.crossJoin(F.broadcast(top))  # one row
    scaled = {p: F.abs(p) / F.when(F.col(f"_{p}") > 0, F.col(f"_{p}")).otherwise(1.0) for p in parts}
    combined = F.col("canonical_class") == "Mech_Elec_Damage"
    risk = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASS_RISK.items() for x in kv]), F.col("canonical_class")), F.lit(0.50))
    return j.select(
        *key,
        "split_role",
        clamp(1 - F.col("missing_ratio")).alias("data_quality"),
        clamp("missing_ratio").alias("missing_ratio"),
        F.when(F.col("canonical_class") == "Healthy", 0.88).otherwise(0.82).alias("confidence"),
        F.when(combined, 0.72).otherwise(0.86).alias("model_agreement"),
        F.when(F.col("fit_ok"), 0.90).otherwise(0.35).alias("representation_agreement"),
        F.when(F.col("fit_ok"), 0.84).otherwise(0.45).alias("explanation_score"),
        F.when(combined, 0.70).otherwise(0.85).alias("domain_consistency_score"),
        risk.alias("risk_score"),
        clamp(scaled["slope"]).alias("slope"),
        clamp(scaled["curvature"]).alias("curvature"),
        clamp(scaled["distance"]).alias("distance_from_healthy"),
        clamp(scaled["distance"] * 0.65 + scaled["curvature"] * 0.35).alias("ood_score"),
    )


#: At which state a fact becomes known; the others are known from the start.
KNOWN_FROM = {"spline_fit_valid": "SPLINE_MODELLING", "diagnosis": "DIAGNOSTIC_INFERENCE", "confidence": "DIAGNOSTIC_INFERENCE", "explanation_score": "EXPLANATION_GENERATION", "explanation_available": "EXPLANATION_GENERATION", "risk_score": "DECISION_CHECK", "ood_score": "DECISION_CHECK", "conflict": "DECISION_CHECK"}


def allowed_targets(state: str = "current_state", matrix: dict[str, dict[str, float]] = STATIC_MATRIX) -> Column:
    out = F.array().cast("array<string>")
    for s, row in matrix.items():
        out = F.when(F.col(state) == s, F.array(*[F.lit(t) for t in row])).otherwise(out)
    return out


def proposal(state: str = "current_state", matrix: dict[str, dict[str, float]] = STATIC_MATRIX) -> Column:
    """The most probable target of a state, the earliest declared of equals."""
    out = F.lit(None).cast("string")
    for s, row in matrix.items():
        out = F.when(F.col(state) == s, F.lit(max(row, key=row.get))).otherwise(out)
    return out


def route_cases(cases: DataFrame, key: str = "case_id", matrix: dict[str, dict[str, float]] = STATIC_MATRIX, steps: int = 8) -> DataFrame:
    """(key, step, current_state, proposed_state, final_state, dominant_rule): every case's way from acquisition to an outcome.

    A step proposes, is guarded with the facts known at its state, and moves. A case ends at an outcome; one that `steps`
    steps don't end gets STEP_LIMIT as its last final state. The steps are a fold within the case's own row;
    cases are dealt anew before it, since one becomes up to `steps` rows.
    """
    c = with_facts(dealt(cases, key)).withColumn("validation_passed", F.coalesce("validation_passed", F.lit(True))).withColumn("input_available", F.coalesce("input_available", F.lit(True))).withColumn("reason", F.coalesce("reason", F.lit("ROUTED")))
    order = {s: k for k, s in enumerate(STATES)}
    ends = ", ".join(f"'{t}'" for t in TERMINAL)
    pick = lambda of: "CASE acc.state " + " ".join(f"WHEN '{s}' THEN {of(row)}" for s, row in matrix.items()) + " END"
    rank = "CASE acc.state " + " ".join(f"WHEN '{s}' THEN {k}" for s, k in order.items()) + " END"
    seen = {f: f"CASE WHEN acc.rank >= {order[KNOWN_FROM[f]]} THEN {f} END" if f in KNOWN_FROM else f for f in FACTS}
    now = {"current_state": "acc.state", "proposed_state": pick(lambda row: repr(max(row, key=row.get))), "allowed": pick(lambda row: f"array({', '.join(map(repr, row))})"), **seen, "path_end": "acc.state"}
    names = re.compile(rf"\b({'|'.join(now)})\b(?!')")
    rules = []
    for k, (rule, action, forced, text) in enumerate(GUARD_RULES, 1):
        goal = f"'{forced}'" if forced else "CAST(NULL AS STRING)"
        hit = f"named_struct('precedence', {PRECEDENCE[action]}, 'priority', {k}, 'rule_id', '{rule}', 'forced', {goal})"
        rules.append(f"CASE WHEN {names.sub(r's.\1', _condition(text, THRESHOLDS))} THEN {hit} END")
    # A one-element array is a name for what is used several times; the fold goes over the steps of one case.
    top = f"array_max(array_compact(array({', '.join(rules)})))"
    target = "CASE WHEN t IS NULL THEN s.proposed_state ELSE coalesce(t.forced, s.current_state) END"
    final = f"CASE WHEN k = {steps - 1} AND {target} NOT IN ({ends}) THEN 'STEP_LIMIT' ELSE {target} END"
    record = f"named_struct('step', k, 'current_state', s.current_state, 'proposed_state', s.proposed_state, 'final_state', {final}, 'dominant_rule', t.rule_id)"
    moved = f"named_struct('state', {target}, 'steps', concat(acc.steps, array({record})))"
    named = ", ".join(f"'{n}', {e}" for n, e in now.items())
    bound = f"transform(array(named_struct({named})), s -> transform(array({top}), t -> {moved})[0])[0]".replace("acc.rank", f"({rank})")
    kind = "array<struct<step:int,current_state:string,proposed_state:string,final_state:string,dominant_rule:string>>"
    start = f"named_struct('state', '{STATES[0]}', 'steps', CAST(array() AS {kind}))"
    fold = f"aggregate(sequence(0, {steps - 1}), {start}, (acc, k) -> CASE WHEN acc.state IN ({ends}) THEN acc ELSE {bound} END, acc -> acc.steps)"
    return c.select(key, F.explode(F.expr(fold)).alias("s")).select(key, "s.*")


def terminal_action(cases: DataFrame, state: str = "final_state") -> DataFrame:
    """Cases with the action code of their outcome."""
    s = F.col(state)
    none = "NO_AUTOMATED_RECOMMENDATION"
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    code = (
        F.when(s == "NO_DECISION", F.when(no("audit_available"), none).otherwise("REQUEST_NEW_DATA"))
        .when(s == "ESCALATION", F.when(no("explanation_available") | F.coalesce(F.col("ood_score") > 0.5, F.lit(False)), none).otherwise("IMMEDIATE_EXPERT_REVIEW"))
        .when(s == "RECOMMENDATION", F.coalesce("action_code", F.lit("CONTINUE_MONITORING")))
        .otherwise(none)
    )
    return cases.withColumn("terminal_action", code)


def frozen_routing(cases: DataFrame, routing: DataFrame) -> DataFrame:
    """(case_id, current_state, selected, probability, status) from a stored table (policy, source, target, pos, probability).

    A single target has probability 1; a state that the policy's table doesn't have is ROUTE_MISSING.
    """
    total = F.sum("probability").over(W.partitionBy("policy", "source"))
    best = routing.withColumn("p", F.col("probability") / total).groupBy("policy", "source").agg(F.max(F.struct("p", -F.col("pos"), "target")).alias("b"))
    j = cases.join(best, (cases.policy == best.policy) & (cases.current_state == best.source), "left").drop(best.policy)
    return j.select("case_id", "policy", "current_state", F.col("b.target").alias("selected"), F.col("b.p").alias("probability"), F.when(F.col("b").isNull(), "ROUTE_MISSING").otherwise("ROUTED").alias("status"))


def posterior_predictive(scores: DataFrame, targets: DataFrame, states: Sequence[str] = TERMINAL, key: str = "case_id") -> DataFrame:
    """(key, split_role, observed_target, entropy, a column a state): the scores of `posterior_scores` beside what was observed."""
    j = targets.select(key, "split_role", F.col("target").alias("observed_target")).join(scores.select(key, "p", "entropy"), key)
    return j.select(key, "split_role", "observed_target", "entropy", *[F.get("p", F.lit(k)).alias(s) for k, s in enumerate(states)])


def bundle_facts(bundles: DataFrame, key: Sequence[str], classes: Sequence[str] = CLASSES) -> DataFrame:
    """(key, state, facts): what each bundle lets each state know, as a map of texts; explanations are absent.

    Where the bundles have them, the trend's slope, curvature and distance from the reference and the class probabilities
    `p`, as JSON, are facts too.
    """
    text = lambda c: F.round(c, 6).cast("decimal(18,6)").cast("string")
    have = set(bundles.columns)
    trend = {f: text(f) for f in ("slope", "curvature", "distance_from_healthy") if f in have}
    named = [F.concat(F.lit(f'"{c}":'), text(F.get("p", F.lit(k)))) for k, c in enumerate(classes)] if "p" in have else []
    likely = {"class_probabilities": F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))} if named else {}
    risk = {"ood_score": text("ood_score")} if "ood_score" in have else {}
    facts = {
        "DATA_VALIDATION": {"validation_passed": F.lit("true")},
        "SPLINE_MODELLING": {"spline_fit_valid": F.lit("true"), **trend},
        "DIAGNOSTIC_INFERENCE": {"diagnosis": F.col("predicted_class"), "confidence": text("confidence"), **likely},
        "EXPLANATION_GENERATION": {"explanation_required": F.lit("true"), "explanation_available": F.lit("false")},
        "DECISION_CHECK": {"risk_score": text("combined_risk"), "conflict": F.col("conflict").cast("string"), **risk},
    }
    rows = F.array(*[F.struct(F.lit(s).alias("state"), F.create_map(*[x for n, v in f.items() for x in (F.lit(n), v)]).alias("facts")) for s, f in facts.items()])
    return bundles.select(*key, F.explode(rows).alias("r")).select(*key, "r.*")
