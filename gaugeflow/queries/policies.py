"""Rules and policies over case tables (L). The rule conditions mean the same to both engines, so both read one text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..operators import policy as po
from ..plans import adapters as ad
from ..schemas import CLASSES
from ._registry import query

TERMINAL = po.TERMINAL
_STATES = "[" + ", ".join(f"'{s}'" for s in TERMINAL) + "]"


def _allowed_sql(state: str) -> str:
    return f"CASE {state} " + " ".join(f"WHEN '{s}' THEN [{', '.join(repr(t) for t in row)}]" for s, row in po.STATIC_MATRIX.items()) + " ELSE [] END"


def _proposal_sql(state: str) -> str:
    return f"CASE {state} " + " ".join(f"WHEN '{s}' THEN '{max(row, key=row.get)}'" for s, row in po.STATIC_MATRIX.items()) + " END"


def _fact_columns(have: str, known: dict[str, str]) -> str:
    """All facts as columns: those that the cases have, those given here, nulls for the rest."""
    return ", ".join(f"{known[f]} AS {f}" if f in known else f if f in have.split() else f"NULL::{'VARCHAR' if t == 'string' else t} AS {f}" for f, t in po.FACTS.items())


_HAVE = "risk_score confidence ood_score missing_ratio data_quality explanation_score explanation_available representation_disagreement classifier_disagreement domain_consistency_score diagnosis conflict spline_fit_valid audit_available"


def _hits_sql() -> str:
    """List of (precedence, priority, rule, action, forced) of the rules that hold."""
    rows = [f"CASE WHEN {po._condition(text, po.THRESHOLDS)} THEN struct_pack(precedence := {po.PRECEDENCE[action]}, priority := {k}, rule_id := '{rule}', action := '{action}', forced := {repr(forced) if forced else 'NULL::VARCHAR'}) END" for k, (rule, action, forced, text) in enumerate(po.GUARD_RULES, 1)]
    return "list_filter([" + ",\n".join(rows) + "], lambda x: x IS NOT NULL)"


_FIRST = "DECISION_CHECK"
_GUARD = {
    "decision_cases": f"SELECT case_id, '{_FIRST}' AS current_state, 'RECOMMENDATION' AS proposed_state, {_allowed_sql(repr(_FIRST))} AS allowed, {_fact_columns(_HAVE, {'validation_passed': 'true', 'input_available': 'case_id % 23 <> 0', 'reason': repr('x'), 'path_end': repr(_FIRST)})} FROM case_facts",
    "hits_t": f"SELECT *, {_hits_sql()} AS triggered FROM decision_cases",
    "tops_t": "SELECT *, list_max(triggered) AS top FROM hits_t",
}


def _decisions(spark, d) -> DataFrame:
    c = ad.case_facts(spark, d).withColumn("current_state", F.lit(_FIRST)).withColumn("proposed_state", F.lit("RECOMMENDATION")).withColumn("allowed", po.allowed_targets())
    return c.withColumn("validation_passed", F.lit(True)).withColumn("input_available", F.col("case_id") % 23 != 0).withColumn("reason", F.lit("x")).withColumn("path_end", F.lit(_FIRST))


@query("SELECT case_id, array_to_string(list_transform(triggered, lambda t: t.rule_id), ';') AS rules FROM hits_t", views=_GUARD)
def apply_guard_rules(spark, d):
    r = po.guard_results(_decisions(spark, d))
    return r.select("case_id", F.array_join(F.transform("triggered", lambda t: t["rule_id"]), ";").alias("rules"))


@query("SELECT case_id, top.rule_id AS dominant_rule, coalesce(top.action, 'ALLOW') AS dominant_action FROM tops_t", views=_GUARD)
def dominant_action(spark, d):
    return po.guard_outcome(po.guard_results(_decisions(spark, d))).select("case_id", "dominant_rule", "dominant_action")


@query("SELECT case_id, CASE WHEN case_id % 29 = 0 THEN 'R15_LOW_CONFIDENCE_ESCALATE_ERROR' ELSE top.rule_id END AS dominant_rule, CASE WHEN case_id % 29 = 0 THEN 'NO_DECISION' WHEN top IS NULL THEN proposed_state ELSE coalesce(top.forced, current_state) END AS final_state, case_id % 29 = 0 OR top IS NOT NULL AS overridden FROM tops_t", views=_GUARD)
def guard_outcome(spark, d):
    """Every 29th case has a confidence that is no number: the rules that read it fail closed."""
    c = _decisions(spark, d).withColumn("confidence", F.when(F.col("case_id") % 29 == 0, "unknown").otherwise(F.col("confidence").cast("string")))
    return po.guard_outcome(po.guard_results(c)).select("case_id", "dominant_rule", "final_state", "overridden")


_PROFILE = {"fired_t": "SELECT case_id, list_filter([" + ", ".join(f"CASE WHEN {po._condition(text, po.THRESHOLDS)} THEN struct_pack(rule_id := '{rule}', outcomes := '{out}') END" for rule, _, out, text in po.PROFILE_RULES) + "], lambda x: x IS NOT NULL) AS h FROM decision_cases"}


@query("SELECT case_id, array_to_string(list_transform(h, lambda x: x.rule_id), ';') AS fired, coalesce(h[1].outcomes, 'RECOMMENDATION') AS allowed_outcomes FROM fired_t", views=_GUARD | _PROFILE)
def rule_profile(spark, d):
    return po.rule_profile(_decisions(spark, d)).select("case_id", "fired", "allowed_outcomes")


_SEEN = {"seen": "SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events", "edges": "SELECT source, target, count(*) AS n FROM seen WHERE target IS NOT NULL GROUP BY ALL"}


def _edges(spark, d) -> DataFrame:
    """(source, target, n): which kind of event follows which."""
    from pyspark.sql import Window as W

    e = ad.table(spark, d, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("target"))
    return e.where("target IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"))


@query("SELECT source, CASE WHEN source = 'error' THEN 0.9::DOUBLE ELSE 1 END AS total, 0::BIGINT AS unknown_targets, 0::BIGINT AS missing_targets, source <> 'error' AS ok FROM edges GROUP BY source", "total", _SEEN)
def validate_matrix(spark, d):
    from pyspark.sql import Window as W

    e = _edges(spark, d)
    p = F.col("n") / F.sum("n").over(W.partitionBy("source")) * F.when(F.col("source") == "error", 0.9).otherwise(1.0)
    return po.validate_matrix(e.withColumn("probability", p), e)


@query("SELECT source, target, n::DOUBLE / sum(n) OVER (PARTITION BY source) AS probability FROM edges", "probability", _SEEN)
def normalize_scores(spark, d):
    return po.normalize_scores(_edges(spark, d).withColumn("score", F.col("n").cast("double")), ["source"]).select("source", "target", "probability")


_PROB = _SEEN | {"probs": "SELECT user_id, event_type AS target, (rank() OVER (PARTITION BY user_id ORDER BY event_type)) AS pos, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS probability FROM events GROUP BY user_id, event_type"}


def _probs(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    n = ad.table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("target")).agg(F.count("*").cast("double").alias("score"))
    n = n.withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("target")))
    return po.normalize_scores(n, ["user_id"])


@query("SELECT user_id, arg_max(target, (round(probability, 12), -pos)) AS selected FROM probs GROUP BY user_id", views=_PROB)
def select_state(spark, d):
    return po.select_state(_probs(spark, d), ["user_id"])


@query("SELECT user_id, coalesce(arg_min(target, pos) FILTER (run > u), arg_max(target, pos)) AS selected FROM (SELECT *, round(sum(probability) OVER (PARTITION BY user_id ORDER BY pos), 12) AS run, ('0x' || substr(sha256('s4|' || user_id), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM probs) GROUP BY user_id", views=_PROB)
def sample_state(spark, d):
    return po.sample_state(_probs(spark, d), ["user_id"], "s4")


_COV = {
    "agreed_facts": "SELECT *, 1 - representation_disagreement / 2 AS model_agreement FROM case_facts",
    "covs": "SELECT case_id, " + ", ".join(f"greatest(0, least(1, {re.sub(r'(distance_from_healthy|spline_curvature|slope|(?<!_)curvature)', 'NULL', e.replace('0.0D', '0').replace('1.0D', '1'))})) AS {n}" for n, e in po.COVARIATES.items()) + " FROM agreed_facts",
    "draw_t": "SELECT i, (i - 31.5) / 2560 AS jitter FROM range(0, 64) t(i)",
    "coef_t": "SELECT i AS sample_id, state, feature, (base::DOUBLE + jitter * (1 + k / 20))::DOUBLE AS coef FROM draw_t, (VALUES " + ", ".join(f"('{s}', '{f}', {k}, {c})" for s, row in po.BASE_COEFFICIENTS.items() for k, (f, c) in enumerate(row.items())) + ") t(state, feature, k, base)",
    "long_t": "SELECT case_id, 'intercept' AS feature, 1.0::DOUBLE AS x FROM covs UNION ALL SELECT case_id, unnest([" + ", ".join(f"'{n}'" for n in po.COVARIATES) + "]), unnest([" + ", ".join(f"{n}::DOUBLE" for n in po.COVARIATES) + "]) FROM covs",
    "logit_t": "SELECT case_id, sample_id, state, sum(x * coef) AS l FROM long_t JOIN coef_t USING (feature) WHERE case_id % 5 = 0 GROUP BY ALL".replace(" WHERE case_id % 5 = 0", ""),
    "soft_t": "SELECT case_id, sample_id, state, exp(l) / sum(exp(l)) OVER (PARTITION BY case_id, sample_id) AS p FROM logit_t",
    "spread_t": "SELECT case_id, state, avg(p) AS mean, var_samp(p) AS variance, list_sort(list(p))[floor(63 * 0.025)::INTEGER + 1] AS low, list_sort(list(p))[ceil(63 * 0.975)::INTEGER + 1] AS high FROM soft_t GROUP BY ALL",
    "post_t": f"SELECT case_id, list(mean / t ORDER BY list_position({_STATES}, state)) AS p, arg_max(state, (round(mean / t, 12), -list_position({_STATES}, state))) AS selected, -sum(mean / t * ln(mean / t)) / ln(3) AS entropy, max(low) FILTER (state = 'RECOMMENDATION') AS rl, max(high) FILTER (state = 'RECOMMENDATION') AS rh, max(low) FILTER (state = 'ESCALATION') AS el, max(high) FILTER (state = 'ESCALATION') AS eh, max(low) FILTER (state = 'NO_DECISION') AS nl, max(high) FILTER (state = 'NO_DECISION') AS nh FROM (SELECT *, sum(mean) OVER (PARTITION BY case_id) AS t FROM spread_t) GROUP BY case_id",
}


def _agreed(spark, d) -> DataFrame:
    return ad.case_facts(spark, d).withColumn("model_agreement", 1 - F.col("representation_disagreement") / 2)


def _spread(spark, d) -> DataFrame:
    return po.posterior_spread(po.policy_covariates(_agreed(spark, d)), po.surrogate_samples(spark))


@query("SELECT * FROM covs", " ".join(po.COVARIATES), _COV)
def policy_covariates(spark, d):
    return po.policy_covariates(_agreed(spark, d))


@query("SELECT case_id, state, mean, variance, low, high FROM spread_t", "mean variance low high", _COV)
def posterior_spread(spark, d):
    return _spread(spark, d).select("case_id", "state", "mean", "variance", "low", "high")


@query("SELECT case_id, p[1] AS p_rec, p[2] AS p_esc, p[3] AS p_no, selected, entropy FROM post_t", "p_rec p_esc p_no entropy", _COV)
def posterior_scores(spark, d):
    s = po.posterior_scores(_spread(spark, d))
    return s.select("case_id", F.col("p")[0].alias("p_rec"), F.col("p")[1].alias("p_esc"), F.col("p")[2].alias("p_no"), "selected", "entropy")


_STATIC = [po.STATIC_MATRIX["DECISION_CHECK"][s] for s in TERMINAL]
_BLEND = _COV | {
    "mixed_t": "SELECT *, CASE WHEN case_id % 7 = 0 THEN 'INVALID_MCMC_DIAGNOSTICS_STATIC_FALLBACK' WHEN entropy >= 0.82 THEN 'HIGH_POSTERIOR_ENTROPY_ESCALATION' WHEN greatest(rl, el) <= least(rh, eh) OR greatest(rl, nl) <= least(rh, nh) OR greatest(el, nl) <= least(eh, nh) THEN 'POSTERIOR_TERMINAL_HDI_OVERLAP_ESCALATION' ELSE 'HYBRID_STATIC_BAYESIAN_BLEND' END AS reason, CASE WHEN case_id % 7 = 0 THEN 0 ELSE greatest(0, least(1, 1 - entropy)) END AS w FROM post_t",
    "blend_t": f"SELECT case_id, reason, CASE WHEN reason LIKE '%ESCALATION' THEN [0.05, 0.9, 0.05] ELSE list_transform([1, 2, 3], lambda i: (1 - w) * ({_STATIC}::DOUBLE[])[i] + w * p[i]) END AS q FROM mixed_t",
}


@query(f"SELECT case_id, reason, {_STATES}[list_position(list_transform(q, lambda x: round(x / list_sum(q), 12)), round(list_max(q) / list_sum(q), 12))] AS selected, q[1] / list_sum(q) AS p_rec, q[2] / list_sum(q) AS p_esc, q[3] / list_sum(q) AS p_no FROM blend_t", "p_rec p_esc p_no", _BLEND)
def hybrid_blend(spark, d):
    h = po.hybrid_blend(_STATIC, po.posterior_scores(_spread(spark, d)), F.col("case_id") % 7 != 0)
    return h.select("case_id", "reason", "selected", F.col("p")[0].alias("p_rec"), F.col("p")[1].alias("p_esc"), F.col("p")[2].alias("p_no"))


_EVENT_COEF = {"ecoef": "SELECT event_type AS state, 'k' || (event_id % 3) AS feature, value AS coef FROM events"}


@query("SELECT state, feature, avg(coef) AS mean, stddev_samp(coef) AS sd, list_sort(list(coef))[floor((count(*) - 1) * 0.025)::INTEGER + 1] AS low, list_sort(list(coef))[ceil((count(*) - 1) * 0.975)::INTEGER + 1] AS high FROM ecoef GROUP BY ALL", "mean sd low high", _EVENT_COEF)
def posterior_summary(spark, d):
    e = ad.table(spark, d, "events").select(F.col("event_type").alias("state"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("feature"), F.col("value").alias("coef"))
    return po.posterior_summary(e)


@query("SELECT vec_id // 100 * 100 + vec_id % 100 AS sample_id, ['s0', 's1'][s + 1] AS state, ['f0', 'f1', 'f2'][f + 1] AS feature, v[f * 2 + s + 1] AS coef FROM vectors, range(0, 3) a(f), range(0, 2) b(s)", "coef")
def posterior_to_long(spark, d):
    v = ad.vectors(spark, d)
    c = v.select(F.floor(F.col("vec_id") / 100).cast("long").alias("chain"), (F.col("vec_id") % 100).alias("draw"), F.array(*[F.array(F.col("v")[2 * f], F.col("v")[2 * f + 1]) for f in range(3)]).alias("coef"))
    return po.posterior_to_long(c, ["f0", "f1", "f2"], ["s0", "s1"], 100)


@query("SELECT case_id, CASE WHEN missing_ratio > 0.20 OR data_quality < 0.70 THEN 'NO_DECISION' WHEN risk_score >= 0.75 OR ood_score >= 0.78 OR representation_agreement < 0.50 THEN 'ESCALATION' ELSE 'RECOMMENDATION' END AS target FROM covs", views=_COV)
def rule_targets(spark, d):
    return po.rule_targets(po.policy_covariates(_agreed(spark, d))).select("case_id", "target")


_TC = ["data_quality", "missing_ratio", "confidence", "model_agreement", "representation_agreement", "explanation_score", "domain_consistency_score", "risk_score", "slope", "curvature", "distance_from_healthy", "ood_score"]
_TC_SQL = """SELECT case_id, split_role, 1 - missing_ratio AS data_quality, missing_ratio, CASE WHEN diagnosis = 'Healthy' THEN 0.88 ELSE 0.82 END::DOUBLE AS confidence, CASE WHEN diagnosis = 'Mech_Elec_Damage' THEN 0.72 ELSE 0.86 END::DOUBLE AS model_agreement, CASE WHEN ok THEN 0.9 ELSE 0.35 END::DOUBLE AS representation_agreement, CASE WHEN ok THEN 0.84 ELSE 0.45 END::DOUBLE AS explanation_score,
CASE WHEN diagnosis = 'Mech_Elec_Damage' THEN 0.7 ELSE 0.85 END::DOUBLE AS domain_consistency_score, CASE diagnosis WHEN 'Healthy' THEN 0.1 WHEN 'Mech_Elec_Damage' THEN 0.9 ELSE 0.55 END::DOUBLE AS risk_score, least(1, a / ma) AS slope, least(1, b / mb) AS curvature, least(1, c / mc) AS distance_from_healthy, least(1, c / mc * 0.65 + b / mb * 0.35) AS ood_score
FROM (SELECT case_id, diagnosis, missing_ratio, spline_fit_valid AS ok, CASE WHEN case_id % 3 = 0 THEN 'test' ELSE 'train' END AS split_role, abs(risk_score - 0.5) AS a, abs(coalesce(ood_score, 0)) AS b, abs(domain_consistency_score) AS c FROM case_facts), (SELECT max(abs(risk_score - 0.5)) AS ma, max(abs(coalesce(ood_score, 0))) AS mb, max(abs(domain_consistency_score)) AS mc FROM case_facts WHERE case_id % 3 <> 0)"""


@query(_TC_SQL, " ".join(_TC))
def transition_covariates(spark, d):
    c = ad.case_facts(spark, d).select("case_id", F.col("diagnosis").alias("canonical_class"), "missing_ratio", F.col("spline_fit_valid").alias("fit_ok"), F.when(F.col("case_id") % 3 == 0, "test").otherwise("train").alias("split_role"), (F.col("risk_score") - 0.5).alias("slope"), F.coalesce("ood_score", F.lit(0.0)).alias("curvature"), F.col("domain_consistency_score").alias("distance"))
    return po.transition_covariates(c, ["case_id"])


@query("SELECT case_id, CASE WHEN case_id % 3 = 0 THEN 'test' ELSE 'train' END AS split_role, CASE WHEN missing_ratio > 0.20 OR data_quality < 0.70 THEN 'NO_DECISION' WHEN risk_score >= 0.75 OR ood_score >= 0.78 OR representation_agreement < 0.50 THEN 'ESCALATION' ELSE 'RECOMMENDATION' END AS observed_target, entropy, " + ", ".join(f'p[{k + 1}] AS "{s}"' for k, s in enumerate(TERMINAL)) + " FROM post_t JOIN covs USING (case_id)", "entropy " + " ".join(TERMINAL), _COV)
def posterior_predictive(spark, d):
    targets = po.rule_targets(po.policy_covariates(_agreed(spark, d))).withColumn("split_role", F.when(F.col("case_id") % 3 == 0, "test").otherwise("train"))
    return po.posterior_predictive(po.posterior_scores(_spread(spark, d)), targets)


def route_views(steps: int = 8) -> dict[str, str]:
    """The routing as a chain of views, a few a step, and `routed` with a row a case and step."""
    order = {s: k for k, s in enumerate(po.STATES)}
    rank = "CASE current_state " + " ".join(f"WHEN '{s}' THEN {k}" for s, k in order.items()) + " END"
    out = {"at0": f"SELECT case_id, '{po.STATES[0]}' AS current_state FROM case_facts"}
    for k in range(steps):
        known = {f: f"CASE WHEN {rank} >= {order[s]} THEN {f} END" for f, s in po.KNOWN_FROM.items()}
        cols = _fact_columns(_HAVE, known | {"validation_passed": "true", "input_available": "true", "reason": "'ROUTED'", "path_end": "current_state"})
        out[f"in_{k}"] = f"SELECT case_id, current_state, {_proposal_sql('current_state')} AS proposed_state, {_allowed_sql('current_state')} AS allowed, {cols} FROM at{k} JOIN case_facts USING (case_id) WHERE current_state NOT IN ('RECOMMENDATION', 'ESCALATION', 'NO_DECISION')"
        out[f"hit{k}"] = f"SELECT case_id, current_state, proposed_state, list_max({_hits_sql()}) AS top FROM in_{k}"
        out[f"step{k}"] = f"SELECT case_id, {k}::INTEGER AS step, current_state, proposed_state, CASE WHEN top IS NULL THEN proposed_state ELSE coalesce(top.forced, current_state) END AS final_state, top.rule_id AS dominant_rule FROM hit{k}"
        out[f"at{k + 1}"] = f"SELECT case_id, final_state AS current_state FROM step{k}"
    out["routed"] = " UNION ALL ".join(f"SELECT case_id, step, current_state, proposed_state, {'final_state' if k < steps - 1 else 'CASE WHEN final_state IN (' + repr(TERMINAL)[1:-1] + ') THEN final_state ELSE ' + repr('STEP_LIMIT') + ' END AS final_state'}, dominant_rule FROM step{k}" for k in range(steps))
    return out


ROUTE = route_views()


def routed(spark, d) -> DataFrame:
    return po.route_cases(ad.case_facts(spark, d))


@query("SELECT * FROM routed", views=ROUTE)
def route_cases(spark, d):
    return routed(spark, d)


_LAST = ROUTE | {"finals": "SELECT case_id, arg_max(final_state, step) AS final_state FROM routed GROUP BY case_id"}


@query("SELECT case_id, final_state, CASE final_state WHEN 'NO_DECISION' THEN CASE WHEN NOT audit_available THEN 'NO_AUTOMATED_RECOMMENDATION' ELSE 'REQUEST_NEW_DATA' END WHEN 'ESCALATION' THEN CASE WHEN NOT explanation_available OR coalesce(ood_score > 0.5, false) THEN 'NO_AUTOMATED_RECOMMENDATION' ELSE 'IMMEDIATE_EXPERT_REVIEW' END WHEN 'RECOMMENDATION' THEN 'CONTINUE_MONITORING' ELSE 'NO_AUTOMATED_RECOMMENDATION' END AS terminal_action FROM finals JOIN case_facts USING (case_id)", views=_LAST)
def terminal_action(spark, d):
    last = routed(spark, d).groupBy("case_id").agg(F.max_by("final_state", "step").alias("final_state"))
    return po.terminal_action(po.with_facts(ad.case_facts(spark, d)).join(last, "case_id")).select("case_id", "final_state", "terminal_action")


@query("SELECT case_id, policy, current_state, CASE WHEN current_state <> 'purchase' THEN t END AS selected, CASE WHEN current_state <> 'purchase' THEN p END AS probability, CASE WHEN current_state = 'purchase' THEN 'ROUTE_MISSING' ELSE 'ROUTED' END AS status FROM (SELECT event_id AS case_id, 'p1' AS policy, event_type AS current_state FROM events) c LEFT JOIN (SELECT source, arg_max(target, (n, target)) AS t, max(n)::DOUBLE / sum(n) AS p FROM edges GROUP BY source) e ON e.source = c.current_state", "probability", _SEEN)
def frozen_routing(spark, d):
    e = _edges(spark, d)
    routing = e.where("source <> 'purchase'").select(F.lit("p1").alias("policy"), "source", "target", F.lit(0).alias("pos"), F.col("n").cast("double").alias("probability"))
    cases = ad.table(spark, d, "events").select(F.col("event_id").alias("case_id"), F.lit("p1").alias("policy"), F.col("event_type").alias("current_state"))
    return po.frozen_routing(cases, routing)


def _text(c: str) -> str:
    return f"coalesce(round({c}, 6)::DECIMAL(18,6)::VARCHAR, '')"


_SHARES = ("1 - risk_score", "risk_score / 4", "risk_score / 2", "risk_score / 4")
_LIKELY = " || ',' || ".join(f"""'"{c}":' || {_text(p)}""" for c, p in zip(CLASSES, _SHARES, strict=True))


@query(f"""SELECT case_id, s AS state, CASE s WHEN 'DATA_VALIDATION' THEN 'validation_passed=true' WHEN 'SPLINE_MODELLING' THEN 'curvature=' || {_text('classifier_disagreement')} || ';slope=' || {_text('missing_ratio')} || ';spline_fit_valid=true'
WHEN 'DIAGNOSTIC_INFERENCE' THEN 'class_probabilities={{' || {_LIKELY} || '}};confidence=' || {_text('confidence')} || ';diagnosis=' || diagnosis WHEN 'EXPLANATION_GENERATION' THEN 'explanation_available=false;explanation_required=true' ELSE 'conflict=' || conflict || ';ood_score=' || {_text('ood_score')} || ';risk_score=' || {_text('risk_score')} END AS facts
FROM case_facts, (VALUES ('DATA_VALIDATION'), ('SPLINE_MODELLING'), ('DIAGNOSTIC_INFERENCE'), ('EXPLANATION_GENERATION'), ('DECISION_CHECK')) t(s)""")
def bundle_facts(spark, d):
    shares = F.array(*[F.expr(p) for p in _SHARES])
    b = ad.case_facts(spark, d).select("case_id", F.col("diagnosis").alias("predicted_class"), "confidence", F.col("risk_score").alias("combined_risk"), "conflict", "ood_score", F.col("missing_ratio").alias("slope"), F.col("classifier_disagreement").alias("curvature"), shares.alias("p"))
    told = F.transform(F.array_sort(F.map_entries("facts")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return po.bundle_facts(b, ["case_id"]).select("case_id", "state", F.array_join(told, ";").alias("facts"))


@query("SELECT (i)::BIGINT AS sample_id, c_custkey, (coef * c_acctbal / 10000)::DOUBLE AS effect FROM (SELECT sample_id AS i, coef FROM coef_t WHERE state = 'ESCALATION' AND feature = 'risk_score') JOIN customer ON c_custkey % 64 = i", "effect", _COV)
def surrogate_samples(spark, d):
    """The surrogate's risk coefficient for escalation, a sample for each customer, times the balance."""
    s = po.surrogate_samples(spark).where("state = 'ESCALATION' AND feature = 'risk_score'")
    c = ad.table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 64).alias("sample_id"))
    return c.join(s, "sample_id").select("sample_id", "c_custkey", (F.col("coef") * F.col("c_acctbal") / 10000).alias("effect"))
