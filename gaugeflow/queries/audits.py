"""Audit logs and event analytics (M)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import audit as au, policy as po
from ..plans import adapters as ad
from ..plans.storage import shared_folder
from ._registry import query
from .policies import _COV, _spread, ROUTE, routed

_CHAIN = {
    "chained": "SELECT run_id, event_index, payload, list_reduce(list_prepend('', list(event_index || '|' || payload) OVER w), lambda a, x: sha256(a || '|' || x)) AS event_hash FROM audit_log WINDOW w AS (PARTITION BY run_id ORDER BY event_index ROWS UNBOUNDED PRECEDING)",
    "linked": "SELECT *, coalesce(lag(event_hash) OVER (PARTITION BY run_id ORDER BY event_index), '') AS previous_event_hash FROM chained",
    # every seventh conversation's third event altered, every eleventh one's second lost
    "damaged": "SELECT run_id, event_index, CASE WHEN run_id % 7 = 0 AND event_index = 3 THEN 'x' ELSE payload END AS payload, previous_event_hash, event_hash FROM linked WHERE NOT (run_id % 11 = 0 AND event_index = 2)",
}


def _chain(spark, d) -> DataFrame:
    return au.build_chain(ad.audit_log(spark, d))


def _damaged(spark, d) -> DataFrame:
    c = _chain(spark, d).where("NOT (run_id % 11 = 0 AND event_index = 2)")
    return c.withColumn("payload", F.when((F.col("run_id") % 7 == 0) & (F.col("event_index") == 3), "x").otherwise(F.col("payload")))


#: SQL of the fields that the events below have, and of their JSON; all others are null.
_FIELD = {"schema_version": "'1.0'", "event_type": "'TURN'", "event_id": "run_id || ':' || lpad(event_index::VARCHAR, 6, '0')", "run_id": "run_id", "event_index": "event_index", "decision_reason": "payload"}
_QUOTED = "array_to_string(list_transform(string_split(to_json({})::VARCHAR, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE printf('\\u%04x', unicode(c)) END), '')"


def _event_json(fields: dict[str, str], hole: str, numbers: tuple[str, ...] = ("run_id", "event_index")) -> str:
    value = lambda f: f"coalesce({fields[f] if f in numbers else _QUOTED.format(fields[f])}::VARCHAR, 'null')" if f in fields else "'null'"
    return "'{' || " + " || ',' || ".join(f"'\"{f}\":' || {hole if f == 'previous_event_hash' else value(f)}" for f in sorted(au.EVENT_FIELDS) if f != "event_hash") + " || '}'"


_EVENTS = {
    "told_t": f"SELECT *, {_event_json(_FIELD, 'chr(1)')} AS told FROM audit_log",
    "hashed_t": "SELECT *, list_reduce(list_prepend('', list(told) OVER w), lambda a, x: sha256(replace(x, chr(1), CASE WHEN a = '' THEN 'null' ELSE '\"' || a || '\"' END))) AS event_hash FROM told_t WINDOW w AS (PARTITION BY run_id ORDER BY event_index ROWS UNBOUNDED PRECEDING)",
    "events_t": "SELECT " + ", ".join(f"{_FIELD.get(f, 'NULL::VARCHAR')} AS {f}" for f in au.EVENT_FIELDS if f not in ("previous_event_hash", "event_hash")) + ", lag(event_hash) OVER (PARTITION BY run_id ORDER BY event_index) AS previous_event_hash, event_hash FROM hashed_t",
    # fields changed, a link changed, an event lost, in some runs
    "spoilt_t": "SELECT * REPLACE (CASE WHEN run_id % 7 = 0 AND event_index = 3 THEN 'x|' ELSE decision_reason END AS decision_reason, CASE WHEN run_id % 5 = 1 AND event_index = 2 THEN NULL ELSE event_type END AS event_type, CASE WHEN run_id % 13 = 2 AND event_index = 2 THEN 'y' ELSE previous_event_hash END AS previous_event_hash) FROM events_t WHERE NOT (run_id % 11 = 0 AND event_index = 2)",
    "made_t": "SELECT *, sha256(" + _event_json({f: f for f in _FIELD}, "coalesce('\"' || previous_event_hash || '\"', 'null')") + ") AS made FROM spoilt_t",
}
#: The same events with texts for their runs.
_EVENT_COLUMNS = ", ".join(au.EVENT_FIELDS)
_TEXT_EVENTS = _EVENTS | {
    "told_t": f"SELECT *, {_event_json(_FIELD, 'chr(1)', ('event_index',))} AS told FROM (SELECT run_id::VARCHAR AS run_id, event_index, payload FROM audit_log)",
}
#: What the chain's table `{}` says of each run, its events' own hashes being `made`.
_VERIFY = """SELECT run_id, count(code) = 0 AS valid, count(*) AS events, min(event_index) FILTER (code IS NOT NULL) AS first_bad, arg_min(code, event_index) FILTER (code IS NOT NULL) AS reason
FROM (SELECT *, CASE WHEN event_index <> n THEN 'MISSING_OR_NONSEQUENTIAL_EVENT' WHEN coalesce(previous_event_hash, '') <> coalesce(p, '') THEN 'PREVIOUS_HASH_MISMATCH' WHEN event_hash <> made THEN 'EVENT_HASH_MISMATCH' END AS code
  FROM (SELECT *, row_number() OVER w AS n, lag(event_hash) OVER w AS p FROM {} WINDOW w AS (PARTITION BY run_id ORDER BY event_index))) GROUP BY run_id"""


def _events(spark, d) -> DataFrame:
    return au.audit_events(ad.audit_log(spark, d).select("run_id", "event_index", F.lit("TURN").alias("event_type"), F.col("payload").alias("decision_reason")))


@query("SELECT * FROM events_t", views=_EVENTS)
def audit_events(spark, d):
    return _events(spark, d)


@query(_VERIFY.format("made_t"), views=_EVENTS)
def verify_events(spark, d):
    """Full events, some of them spoilt, verified from their own fields."""
    e = _events(spark, d).where("NOT (run_id % 11 = 0 AND event_index = 2)")
    put = lambda f, k, r, n, v: F.when((F.col("run_id") % k == r) & (F.col("event_index") == n), F.lit(v)).otherwise(F.col(f))
    e = e.withColumns({"decision_reason": put("decision_reason", 7, 0, 3, "x|"), "event_type": put("event_type", 5, 1, 2, None), "previous_event_hash": put("previous_event_hash", 13, 2, 2, "y")})
    return au.verify_chain(e, ad.audit_log(spark, d).select("run_id"))


@query("SELECT run_id::VARCHAR AS run_id, run_id % 3 <> 0 OR m < 2 AS valid, n AS events, CASE WHEN run_id % 3 = 0 AND m >= 2 THEN 2 END::BIGINT AS first_bad, CASE WHEN run_id % 3 = 0 AND m >= 2 THEN 'EVENT_HASH_MISMATCH' END AS reason FROM (SELECT run_id, count(*) AS n, max(event_index) AS m FROM audit_log GROUP BY run_id)")
def verify_log(spark, d):
    """Events written as lines of canonical JSON, a third of the runs with a changed line, read and verified from the lines."""
    path = shared_folder(spark, "audit-lines")
    lines = au.event_lines(_events(spark, d))
    changed = F.regexp_replace("value", '"decision_reason":"', '"decision_reason":"not ')
    hit = (F.get_json_object("value", "$.run_id").cast("long") % 3 == 0) & (F.get_json_object("value", "$.event_index") == "2")
    lines.select(F.when(hit, changed).otherwise(F.col("value")).alias("value")).write.text(path)
    return au.verify_chain(au.parse_lines(spark.read.text(path)), ad.audit_log(spark, d).select(F.col("run_id").cast("string").alias("run_id")))


@query("SELECT run_id, event_index, payload, previous_event_hash, event_hash FROM linked", views=_CHAIN)
def build_chain(spark, d):
    return _chain(spark, d)


@query("(" + _VERIFY.format("(SELECT *, sha256(previous_event_hash || '|' || event_index || '|' || payload) AS made FROM damaged)") + ") UNION ALL SELECT -1, false, 0, NULL, 'EMPTY_AUDIT_LOG'", views=_CHAIN)
def verify_chain(spark, d):
    runs = ad.audit_log(spark, d).select("run_id")
    return au.verify_chain(_damaged(spark, d), runs.union(runs.limit(1).select(F.lit(-1).cast("long"))))


@query("SELECT run_id, bool_and(event_index = 1 OR previous_event_hash = coalesce(p, '')) AS linked FROM (SELECT *, lag(event_hash) OVER (PARTITION BY run_id ORDER BY event_index) AS p FROM damaged) GROUP BY run_id", views=_CHAIN)
def chain_linkage(spark, d):
    return au.chain_linkage(_damaged(spark, d))


@query("SELECT run_id, NOT (bool_or(run_id % 7 = 0 AND event_index = 3) OR bool_or(run_id % 11 = 0 AND event_index = 2)) AS same FROM audit_log GROUP BY run_id")
def replay_signature(spark, d):
    return au.replay_signature(_chain(spark, d), _damaged(spark, d), ["payload", "event_hash"])


_STEPS = ROUTE | {
    "steps_t": "SELECT r.*, sha256(case_id || '|' || step || '|' || current_state || '|' || final_state) AS step_hash, o_orderpriority AS scenario, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS policy FROM routed r JOIN orders ON o_orderkey = case_id",
    "reports_t": "SELECT case_id, any_value(scenario) AS scenario, any_value(policy) AS policy, string_agg(final_state, ' > ' ORDER BY step) AS path, array_to_string(list_sort(list_distinct(list(dominant_rule) FILTER (dominant_rule IS NOT NULL))), ';') AS rules, string_agg(coalesce(dominant_rule, 'ACCEPT'), ';' ORDER BY step) AS decisions, arg_min(step_hash, step) AS first_hash, arg_max(step_hash, step) AS last_hash, arg_max(final_state, step) AS outcome, count(dominant_rule) AS overrides, count(*) AS length FROM steps_t GROUP BY case_id",
    "clean_t": "SELECT * REPLACE (coalesce(rules, '') AS rules) FROM reports_t",
}


def _steps(spark, d) -> DataFrame:
    o = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("scenario"), F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("policy"))
    return routed(spark, d).join(o, "case_id")


def _reports(spark, d) -> DataFrame:
    return au.case_reports(_steps(spark, d), carry=["scenario", "policy"])


@query("SELECT case_id, path, rules, decisions, outcome, overrides, length, first_hash, last_hash FROM clean_t", views=_STEPS)
def case_reports(spark, d):
    return au.case_reports(_steps(spark, d))


_PROBS = "(VALUES " + ", ".join(f"('{s}', '{t}', {p})" for s, row in po.STATIC_MATRIX.items() for t, p in row.items()) + ") m(source, target, probability)"


@query(f"SELECT policy, e.source, e.target, n, n::DOUBLE / sum(n) OVER (PARTITION BY policy, e.source) AS rate, coalesce(probability, 0)::DOUBLE AS probability, overrides, overrides::DOUBLE / n AS override_rate FROM (SELECT policy, current_state AS source, final_state AS target, count(*) AS n, count(dominant_rule) AS overrides FROM steps_t GROUP BY ALL) e LEFT JOIN {_PROBS} USING (source, target)", "rate probability override_rate", _STEPS)
def transition_edges(spark, d):
    return au.transition_edges(_steps(spark, d), ["policy"], po.matrix_table(spark))


_SHARE = "avg((outcome = '{}')::INTEGER)"


_ENTROPY = "(VALUES " + ", ".join(f"('{x}', {-sum(p * math.log(p) for p in row.values()) / math.log(len(row)) if len(row) > 1 else 0.0!r})" for x, row in po.STATIC_MATRIX.items()) + ") h(source, entropy)"
_METRICS = _STEPS | {
    "told_steps": f"SELECT case_id, sum(entropy::DOUBLE) AS transition_entropy, count(*) FILTER (current_state IN ('EXPLANATION_GENERATION', 'DECISION_CHECK')) AS explanation_known, count(*) FILTER (current_state IN ('EXPLANATION_GENERATION', 'DECISION_CHECK') AND case_id % 7 <> 0) AS explained FROM steps_t LEFT JOIN {_ENTROPY} ON source = current_state GROUP BY case_id",
}


@query(f"SELECT policy, count(*) AS cases, {_SHARE.format('RECOMMENDATION')} AS recommendation_rate, {_SHARE.format('ESCALATION')} AS escalation_rate, {_SHARE.format('NO_DECISION')} AS no_decision_rate, sum(overrides)::BIGINT AS overrides, avg(length) AS mean_length, list_sort(list(length))[count(*) // 2 + 1] AS median_length, avg(contains(rules, 'CONFLICT')::INTEGER) AS conflict_rate, sum(transition_entropy) / sum(length) AS transition_entropy, coalesce(sum(explained)::DOUBLE / nullif(sum(explanation_known), 0), 0) AS explanation_availability, 1.0::DOUBLE AS audit_completeness FROM clean_t JOIN told_steps USING (case_id) GROUP BY policy", "recommendation_rate escalation_rate no_decision_rate mean_length conflict_rate transition_entropy explanation_availability audit_completeness", _METRICS)
def policy_metrics(spark, d):
    """Explanations are known from their own state on; a chain is complete where every step names the hash before it."""
    told = F.col("current_state").isin("EXPLANATION_GENERATION", "DECISION_CHECK")
    linked = F.col("previous_event_hash") == F.lag("event_hash", 1, au.GENESIS).over(Window.partitionBy("case_id").orderBy("step"))
    flat = au.flatten_transitions(_steps(spark, d), "case_id", po.matrix_table(spark), carry=["scenario", "policy", "dominant_rule"]).withColumn("linked", linked)
    more = [F.sum("transition_entropy").alias("transition_entropy"), F.count_if(told).alias("explanation_known"), F.count_if(told & (F.col("case_id") % 7 != 0)).alias("explained"), F.bool_and("linked").alias("chain_complete")]
    return au.policy_metrics(au.case_reports(flat, carry=["scenario", "policy"], more=more), ["policy"])


_COMPARE = f"SELECT policy, scenario, count(*) AS cases, count(*) FILTER (outcome = 'RECOMMENDATION') AS recommendations, count(*) FILTER (outcome = 'ESCALATION') AS escalations, count(*) FILTER (outcome = 'NO_DECISION') AS no_decisions, {_SHARE.format('ESCALATION')} AS escalation_rate FROM clean_t GROUP BY GROUPING SETS ((policy), (policy, scenario))"


@query(_COMPARE, "escalation_rate", _STEPS)
def policy_comparison(spark, d):
    return au.policy_comparison(_reports(spark, d), "policy", "scenario")


@query(f"SELECT policy, scenario, CASE WHEN scenario IS NULL THEN 'OUTCOMES_DONT_SUM' END AS code FROM ({_COMPARE})", views=_STEPS)
def check_comparison(spark, d):
    c = au.policy_comparison(_reports(spark, d), "policy", "scenario")
    return au.check_comparison(c.withColumn("cases", F.when(F.col("scenario").isNull(), F.col("cases") + 1).otherwise(F.col("cases")))).select("policy", "scenario", "code")


@query("SELECT case_id, outcome, length AS evaluations, overrides FROM clean_t", views=_STEPS)
def run_summary(spark, d):
    return au.run_summary(_steps(spark, d))


@query("SELECT case_id, step, final_state AS state FROM steps_t", views=_STEPS)
def explode_paths(spark, d):
    return au.explode_paths(_reports(spark, d))


@query("SELECT path, count(*) AS runs, any_value(length)::INTEGER AS length, any_value(outcome) AS terminal FROM clean_t GROUP BY path", views=_STEPS)
def distinct_paths(spark, d):
    return au.distinct_paths(_reports(spark, d))


_CELLS = [f"{_SHARE.format('ESCALATION')} FILTER (policy = '{p}') AS {p}_escalation, avg(length) FILTER (policy = '{p}') AS {p}_length, (sum(overrides) FILTER (policy = '{p}'))::BIGINT AS {p}_overrides" for p in ("even", "odd")]


@query(f"SELECT scenario, {', '.join(_CELLS)} FROM clean_t GROUP BY scenario", "even_escalation even_length odd_escalation odd_length", _STEPS)
def outcome_matrix(spark, d):
    return au.outcome_matrix(_reports(spark, d), "scenario", "policy", ["even", "odd"])


@query("SELECT path_hash, 'EB' || dense_rank() OVER (ORDER BY path_hash) AS tag FROM (SELECT DISTINCT sha256(path) AS path_hash FROM clean_t)", views=_STEPS)
def hash_tags(spark, d):
    return au.hash_tags(au.distinct_paths(_reports(spark, d)).select(F.sha2("path", 256).alias("path_hash")), "path_hash")


@query("SELECT 'linkage' AS \"check\", count(*) FILTER (NOT (run_id % 11 = 0 AND m > 2)) AS verified, count(*) AS total FROM (SELECT run_id, max(event_index) AS m FROM damaged GROUP BY run_id) UNION ALL SELECT 'replay', count(*) FILTER (NOT ((run_id % 7 = 0 AND m > 2) OR (run_id % 11 = 0 AND m > 1))), count(*) FROM (SELECT run_id, max(event_index) AS m FROM audit_log GROUP BY run_id)", views=_CHAIN)
def integrity_summary(spark, d):
    bad = _damaged(spark, d)
    return au.integrity_summary([("linkage", au.chain_linkage(bad), "linked"), ("replay", au.replay_signature(_chain(spark, d), bad, ["payload"]), "same")])


@query("SELECT scenario, string_agg(DISTINCT current_state, ',' ORDER BY current_state) AS states FROM steps_t GROUP BY scenario", views=_STEPS)
def scenario_coverage(spark, d):
    return au.scenario_coverage(_steps(spark, d), "scenario")


@query("SELECT count(*) AS cases, avg((outcome = CASE WHEN case_id % 2 = 0 THEN 'ESCALATION' ELSE 'NO_DECISION' END)::INTEGER) AS met FROM clean_t", "met", _STEPS)
def expected_action_check(spark, d):
    r = au.case_reports(_steps(spark, d)).select("case_id", F.col("outcome").alias("terminal_action"))
    expected = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 2 == 0, "ESCALATION").otherwise("NO_DECISION").alias("expected_action"))
    return au.expected_action_check(r, expected, "case_id")


_ROWS = "(VALUES " + ", ".join(f"""('{s}', '{';'.join(row)}', '{{{{{','.join(f'"{t}":{p:.6f}' for t, p in row.items())}}}}}')""" for s, row in po.STATIC_MATRIX.items()).replace("{{", "{").replace("}}", "}") + ") a(source, allowed_next_states, scores)"
_FLAT = _STEPS | _COV | {
    "flat_t": f"SELECT case_id, step, current_state, allowed_next_states, scores AS raw_scores, scores AS normalized_probabilities, proposed_state, coalesce(probability, 0)::DOUBLE AS selected_probability, h.entropy::DOUBLE AS transition_entropy, CASE WHEN current_state = 'DECISION_CHECK' THEN post_t.entropy END AS posterior_entropy, final_state, coalesce(dominant_rule, '') AS safety_override, sha256(case_id || '|' || step || '|' || current_state || '|' || final_state) AS event_hash FROM routed LEFT JOIN {_ROWS} ON a.source = current_state LEFT JOIN {_PROBS} ON m.source = current_state AND m.target = proposed_state LEFT JOIN {_ENTROPY} ON h.source = current_state LEFT JOIN post_t USING (case_id)"
}


@query("SELECT *, coalesce(lag(event_hash) OVER (PARTITION BY case_id ORDER BY step), '') AS previous_event_hash FROM flat_t", "selected_probability transition_entropy posterior_entropy", _FLAT)
def flatten_transition_events(spark, d):
    posterior = po.posterior_scores(_spread(spark, d)).select("case_id", F.lit("DECISION_CHECK").alias("source"), "entropy")
    return au.flatten_transitions(routed(spark, d), "case_id", po.matrix_table(spark), posterior)


_ORD = "CASE state " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(po.STATES)) + " ELSE -1 END"


@query(f"SELECT policy, 'node' AS kind, state, NULL AS target, {_ORD} AS ordinal, sum(n)::BIGINT AS n, NULL::DOUBLE AS share FROM (SELECT policy, unnest([current_state, final_state]) AS state, count(*) AS n FROM steps_t GROUP BY policy, current_state, final_state) GROUP BY policy, state UNION ALL SELECT policy, 'edge', current_state, final_state, NULL, count(*), count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY policy, current_state) FROM steps_t GROUP BY policy, current_state, final_state", "share", _STEPS)
def policy_edge_graph(spark, d):
    """The nodes and the edges of each policy in one table."""
    nodes, edges = au.edge_graph(_steps(spark, d), {s: k for k, s in enumerate(po.STATES)}, ["policy"])
    n = nodes.select("policy", F.lit("node").alias("kind"), "state", F.lit(None).cast("string").alias("target"), "ordinal", F.col("visits").alias("n"), F.lit(None).cast("double").alias("share"))
    return n.unionByName(edges.select("policy", F.lit("edge").alias("kind"), F.col("source").alias("state"), "target", F.lit(None).cast("int").alias("ordinal"), "n", "share"))
