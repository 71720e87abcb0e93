"""Audit logs: hash chains, reports and event analytics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.canonical import canonical_json, canonical_parts
from ..functions.columns import content_hash, first_reason, fixed, normalized_entropy

GENESIS = ""


# The fields of an audit event, in order.
EVENT_FIELDS = (
    "schema_version", "event_type", "event_id", "event_index", "run_id", "experiment_fingerprint", "case_id", "window_id", "timestamp", "state_from", "state_to", "transition_policy",
    "transition_policy_version", "candidate_states", "raw_transition_scores", "normalized_probabilities", "selected_state", "selection_mode", "rng_seed_or_stream_id", "active_state_strategy",
    "strategy_version", "strategy_params_hash", "safety_rules_evaluated", "safety_rules_triggered", "safety_override", "diagnosis", "class_probabilities", "confidence", "spline_summary",
    "explanation_score", "top_explanatory_features", "risk_score", "ood_score", "decision_reason", "final_action", "input_hash", "config_hash", "model_hash", "git_commit", "previous_event_hash", "event_hash",
)


def _fold(events: DataFrame, order: Sequence[str], opened: str, closed: str, none: str) -> DataFrame:
    """Events with previous_event_hash and event_hash, the SHA-256 of `before`, the hash of the run's event before, and `after`.

    A chain is a fold in order: a run's events stand sorted in one partition and pass through batch by batch, with one hash
    carried on, so a run may be of any length. `opened` and `closed` stand around a hash, `none` instead of the first one.
    """
    kept = [f for f in events.schema.fields if f.name not in ("before", "after")]
    first, left, right = none.encode(), opened.encode(), closed.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, current, last = False, None, None
        for b in batches:
            previous, hashes = [], []
            for run_id, before, after in zip(*(b.column(c).to_pylist() for c in ("run_id", "before", "after")), strict=True):
                if not begun or run_id != current:
                    begun, current, last = True, run_id, None
                previous.append(last)
                last = hashlib.sha256(before + (first if last is None else left + last.encode() + right) + after).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(previous, pa.string()), pa.array(hashes, pa.string())], [*(f.name for f in kept), "previous_event_hash", "event_hash"])

    schema = T.StructType([*kept, T.StructField("previous_event_hash", T.StringType()), T.StructField("event_hash", T.StringType())])
    rows = events.withColumns({c: F.col(c).cast("binary") for c in ("before", "after")})
    return rows.repartition("run_id").sortWithinPartitions("run_id", *order).mapInArrow(run, schema)


def _event_parts(events: DataFrame) -> tuple[Column, Column]:
    """An event's canonical JSON without its own hash, before and after the value of previous_event_hash."""
    return canonical_parts({f.name: f.dataType for f in events.schema.fields if f.name in EVENT_FIELDS and f.name not in ("previous_event_hash", "event_hash")}, "previous_event_hash")


def audit_events(rows: DataFrame, order: Sequence[str] = ("event_index",), schema_version: str = "1.0") -> DataFrame:
    """Audit events with all fields: numbered from 1 in each run_id and chained by hashes, the first one's previous hash being null.

    A field that the rows have keeps its type, one that they lack is a null text. An event's hash covers the canonical JSON of
    all its fields but itself.
    """
    n = F.row_number().over(W.partitionBy("run_id").orderBy(*order)).cast("long")
    have = set(rows.columns)
    made = {"event_index": n, "schema_version": F.lit(schema_version)} | {f: F.col(f) if f in have else F.lit(None).cast("string") for f in EVENT_FIELDS if f not in ("event_index", "event_id", "schema_version", "run_id", "previous_event_hash", "event_hash")}
    e = rows.select("run_id", *[c.alias(f) for f, c in made.items()]).withColumn("event_id", F.format_string("%s:%06d", F.col("run_id").cast("string"), F.col("event_index")))
    before, after = _event_parts(e)
    return _fold(e.withColumns({"before": before, "after": after}), ["event_index"], '"', '"', "null").select(*EVENT_FIELDS)


def event_hash(events: DataFrame) -> Column:
    """The hash that a full event has to have, made from its own fields."""
    before, after = _event_parts(events)
    return F.sha2(F.concat(before, F.coalesce(F.concat(F.lit('"'), F.replace("previous_event_hash", F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null")), after), 256)


def event_lines(events: DataFrame) -> DataFrame:
    """(value): each full event as a line of canonical JSON, its hash among the fields."""
    return events.select(canonical_json(F.struct(*EVENT_FIELDS), T.StructType([events.schema[f] for f in EVENT_FIELDS])).alias("value"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(run_id, event_index, previous_event_hash, event_hash, made_hash) of a log's lines of canonical JSON, blank ones aside.

    made_hash is the hash of the line without its own hash, whatever other fields it has and however its numbers are written.
    A line that isn't JSON, or isn't canonical, has a hash that its event doesn't name.
    """
    kind = "run_id string, event_index long, previous_event_hash string, event_hash string"
    told = F.from_json("value", kind)
    rest = F.regexp_replace("value", '"event_hash":"[^"]*",("event_id":)', "$1")
    return lines.where(F.btrim("value") != "").select(*[told[c].alias(c) for c in ("run_id", "event_index", "previous_event_hash", "event_hash")], F.sha2(rest, 256).alias("made_hash"))


def _hash(index: Column, payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, index.cast("string"), payload), 256)


def build_chain(events: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(run_id, event_index, payload, the columns `carry`, previous_event_hash, event_hash): each hash covers the one before, the index and the payload."""
    e = events.select("run_id", "event_index", F.coalesce("payload", F.lit("")).alias("payload"), *carry)
    parts = {"before": F.lit(""), "after": F.concat(F.lit("|"), F.col("event_index").cast("string"), F.lit("|"), F.col("payload"))}
    return _fold(e.withColumns(parts), ["event_index", "payload", *carry], "", "", "").withColumn("previous_event_hash", F.coalesce("previous_event_hash", F.lit(GENESIS)))


def made_hash(chain: DataFrame) -> Column:
    """The hash that each event of a chain has to have: of its payload, of its line, or of all its fields."""
    if "made_hash" in chain.columns:
        return F.col("made_hash")
    return _hash(F.col("event_index"), F.col("payload"), F.col("previous_event_hash")) if "payload" in chain.columns else event_hash(chain)


def verify_chain(chain: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, valid, events, first_bad, reason) of every run listed: the first failing event in order, or EMPTY_AUDIT_LOG.

    `chain` is of build_chain, audit_events or parse_lines. An event fails by its index (the one before is absent, or there
    are several), then by its link to the event before, then by its own hash, made again from what the event holds. Events
    meet the one before by a join on run and index, so that a long run is dealt over all tasks.
    """
    own = F.coalesce(F.col("event_hash") != made_hash(chain), F.lit(True))
    link = F.coalesce("previous_event_hash", F.lit(GENESIS))
    at = chain.select("run_id", "event_index", "event_hash", link.alias("link"), own.alias("other"))
    at = at.groupBy("run_id", "event_index").agg(F.count("*").alias("copies"), F.min("event_hash").alias("hash"), F.min("link").alias("link"), F.bool_or("other").alias("other"))
    before = at.select(F.col("run_id").alias("of"), (F.col("event_index") + 1).alias("next"), F.col("hash").alias("named"))
    c = at.join(before, at.run_id.eqNullSafe(before.of) & (F.col("event_index") == F.col("next")), "left")
    lost = (F.col("copies") > 1) | F.col("event_index").isNull() | (F.col("event_index") < 1) | ((F.col("event_index") > 1) & F.col("next").isNull())
    code = first_reason((lost, "MISSING_OR_NONSEQUENTIAL_EVENT"), (F.col("link") != F.coalesce("named", F.lit(GENESIS)), "PREVIOUS_HASH_MISMATCH"), (F.col("other"), "EVENT_HASH_MISMATCH"))
    g = c.withColumn("_c", code).groupBy("run_id").agg(F.sum("copies").alias("events"), F.min(F.when(F.col("_c").isNotNull(), F.struct("event_index", "_c"))).alias("bad"))
    listed = runs.select(F.col("run_id").alias("of")).distinct()
    j = listed.join(g, listed.of.eqNullSafe(g.run_id), "left").drop("run_id").withColumnRenamed("of", "run_id")
    return j.select("run_id", (F.col("events").isNotNull() & F.col("bad").isNull()).alias("valid"), F.coalesce("events", F.lit(0)).alias("events"), F.col("bad.event_index").alias("first_bad"), F.when(F.col("events").isNull(), "EMPTY_AUDIT_LOG").otherwise(F.col("bad._c")).alias("reason"))


def chain_linkage(chain: DataFrame) -> DataFrame:
    """(run_id, linked): every event names the hash before it."""
    w = W.partitionBy("run_id").orderBy("event_index")
    return chain.withColumn("_ok", F.col("previous_event_hash").eqNullSafe(F.lag("event_hash", 1, GENESIS).over(w))).groupBy("run_id").agg(F.bool_and("_ok").alias("linked"))


def replay_signature(first: DataFrame, second: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(run_id, same): whether two logs agree on the fields, event by event."""
    pack = lambda df, n: df.select("run_id", "event_index", F.struct(*fields).alias(n))
    j = pack(first, "x").join(pack(second, "y"), ["run_id", "event_index"], "full_outer")
    return j.groupBy("run_id").agg(F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("same"))


def step_hash(key: str = "case_id") -> Column:
    """The hash of a step's own fields."""
    return content_hash(key, "step", "current_state", "final_state")


def case_reports(steps: DataFrame, key: str = "case_id", carry: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """(key, carry, more, path, rules, decisions, outcome, overrides, length, first_hash, last_hash) of each case's steps.

    `carry` are columns that a case's steps share, `more` aggregates with names of their own; a decision is the dominant rule of a step, or ACCEPT. A case has few steps.
    """
    item = F.struct("step", "final_state", F.coalesce("dominant_rule", F.lit("ACCEPT")).alias("decision"), step_hash(key).alias("hash"))
    rules = F.array_join(F.array_sort(F.collect_set("dominant_rule")), ";")
    g = steps.groupBy(key, *carry).agg(F.array_sort(F.collect_list(item)).alias("s"), rules.alias("rules"), F.count("dominant_rule").alias("overrides"), F.count("*").alias("length"), *more)
    return g.select(
        key,
        *carry,
        *[c for c in g.columns[len(carry) + 5 :]],
        F.array_join(F.transform("s", lambda x: x["final_state"]), " > ").alias("path"),
        "rules",
        F.array_join(F.transform("s", lambda x: x["decision"]), ";").alias("decisions"),
        F.element_at("s", -1)["final_state"].alias("outcome"),
        "overrides",
        "length",
        F.element_at("s", 1)["hash"].alias("first_hash"),
        F.element_at("s", -1)["hash"].alias("last_hash"),
    )


def transition_edges(steps: DataFrame, by: Sequence[str], probabilities: DataFrame) -> DataFrame:
    """(by, source, target, n, rate, probability, overrides, override_rate): rate is within the source."""
    g = steps.groupBy(*by, F.col("current_state").alias("source"), F.col("final_state").alias("target")).agg(F.count("*").alias("n"), F.count("dominant_rule").alias("overrides"))
    rate = F.col("n") / F.sum("n").over(W.partitionBy(*by, "source"))
    g = g.withColumn("rate", rate).join(probabilities.select("source", "target", "probability"), ["source", "target"], "left")
    return g.select(*by, "source", "target", "n", "rate", F.coalesce("probability", F.lit(0.0)).alias("probability"), "overrides", (F.col("overrides") / F.col("n")).alias("override_rate"))


def _share(outcome: str) -> Column:
    return F.avg((F.col("outcome") == outcome).cast("double"))


def policy_metrics(reports: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, cases, outcome rates, overrides, mean and upper median path length, conflict rate) of case reports.

    Where the reports have them: the mean transition and posterior entropy of the steps (sums `transition_entropy` over
    `length`, `posterior_entropy` over `posterior_steps`), the share of steps whose explanation is available among those that
    tell (`explained` over `explanation_known`, 0 if none tells), and the share of complete audit chains (`chain_complete`).
    """
    have = set(reports.columns)
    n = F.count("*")
    more = []
    if "transition_entropy" in have:
        more.append((F.sum("transition_entropy") / F.sum("length")).alias("transition_entropy"))
    if "posterior_entropy" in have:
        more.append(F.try_divide(F.sum("posterior_entropy"), F.sum("posterior_steps")).alias("posterior_entropy"))
    if "explained" in have:
        more.append(F.coalesce(F.try_divide(F.sum("explained"), F.sum("explanation_known")), F.lit(0.0)).alias("explanation_availability"))
    if "chain_complete" in have:
        more.append(F.avg(F.col("chain_complete").cast("double")).alias("audit_completeness"))
    return reports.groupBy(*by).agg(
        n.alias("cases"),
        _share("RECOMMENDATION").alias("recommendation_rate"),
        _share("ESCALATION").alias("escalation_rate"),
        _share("NO_DECISION").alias("no_decision_rate"),
        F.sum("overrides").alias("overrides"),
        F.avg("length").alias("mean_length"),
        # percentile_disc takes the lower of two middle values; from the top it is the upper one
        (-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -length)")).cast("long").alias("median_length"),
        F.avg(F.contains("rules", F.lit("CONFLICT")).cast("double")).alias("conflict_rate"),
        *more,
    )


def policy_comparison(reports: DataFrame, policy: str, scenario: str) -> DataFrame:
    """Counts and rates by policy, and by policy and scenario (null: all), in one pass."""
    g = reports.groupingSets([[policy], [policy, scenario]], policy, scenario)
    count = lambda o: F.count_if(F.col("outcome") == o)
    return g.agg(F.count("*").alias("cases"), count("RECOMMENDATION").alias("recommendations"), count("ESCALATION").alias("escalations"), count("NO_DECISION").alias("no_decisions"), _share("ESCALATION").alias("escalation_rate"))


def check_comparison(comparison: DataFrame) -> DataFrame:
    """The comparison with `code`, null where counts are sane and sum up."""
    total = F.col("recommendations") + F.col("escalations") + F.col("no_decisions")
    return comparison.withColumn("code", first_reason((F.least("cases", "recommendations", "escalations", "no_decisions") < 0, "NEGATIVE_COUNT"), (~F.col("escalation_rate").between(0.0, 1.0), "RATE_RANGE"), (total != F.col("cases"), "OUTCOMES_DONT_SUM")))


def run_summary(steps: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, outcome, evaluations, overrides)."""
    return steps.groupBy(key).agg(F.max_by("final_state", "step").alias("outcome"), F.count("*").alias("evaluations"), F.count("dominant_rule").alias("overrides"))


def explode_paths(reports: DataFrame, key: str = "case_id") -> DataFrame:
    return reports.select(key, F.posexplode(F.split("path", " > ")).alias("step", "state"))


def distinct_paths(reports: DataFrame) -> DataFrame:
    """(path, runs, length, terminal)."""
    s = F.split("path", " > ")
    return reports.groupBy("path").agg(F.count("*").alias("runs")).select("path", "runs", F.size(s).alias("length"), F.element_at(s, -1).alias("terminal"))


def outcome_matrix(reports: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """A row a scenario; a policy has the columns `<policy>_escalation`, `_length` and `_overrides`: the share of escalations,
    the mean path length and the overrides; null where there is no case."""
    figures = (_share("ESCALATION").alias("escalation"), F.avg("length").alias("length"), F.sum("overrides").alias("overrides"))
    return reports.groupBy(rows).pivot(columns, list(values)).agg(*figures)


def hash_tags(df: DataFrame, column: str, prefix: str = "EB") -> DataFrame:
    """(column, tag): the different hashes numbered in order. Meant for the hashes of a report: their list is ranked as one."""
    d = df.select(column).distinct()
    return d.withColumn("tag", F.concat(F.lit(prefix), F.dense_rank().over(W.orderBy(column)).cast("string")))


def integrity_summary(checks: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(check, verified, total) of boolean columns."""
    out = None
    for name, df, flag in checks:
        one = df.agg(F.count_if(F.col(flag)).alias("verified"), F.count("*").alias("total")).select(F.lit(name).alias("check"), "verified", "total")
        out = one if out is None else out.unionAll(one)
    return out


def scenario_coverage(steps: DataFrame, scenario: str) -> DataFrame:
    """(scenario, states): sorted different states."""
    return steps.groupBy(scenario).agg(F.array_join(F.array_sort(F.collect_set("current_state")), ",").alias("states"))


def expected_action_check(actions: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(cases, met): share of cases whose action is the expected one."""
    j = actions.join(expected, key)
    return j.agg(F.count("*").alias("cases"), F.avg((F.col("terminal_action") == F.col("expected_action")).cast("double")).alias("met"))


def flatten_transitions(steps: DataFrame, key: str, matrix: DataFrame, posterior: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Wide rows of steps: allowed states joined by `;`, scores and probabilities as JSON in the declared order, the selected
    probability, the entropy of the choice scaled to 0 .. 1, the guard's override, the hash of the step before and the own one.

    `posterior` (key, source, entropy) gives `posterior_entropy` where a posterior had a say, null elsewhere.
    """
    order = F.array_sort(F.collect_list(F.struct("pos", "target", "probability")))
    m = matrix.groupBy("source").agg(order.alias("_row"), F.sum("probability").alias("_total"))  # a row a state
    probability = F.transform("_row", lambda x: x["probability"] / F.col("_total"))
    json = lambda v: F.concat(F.lit("{"), F.array_join(F.zip_with("_row", v, lambda x, p: F.concat(F.lit('"'), x["target"], F.lit('":'), fixed(p))), ","), F.lit("}"))
    m = m.select(
        F.col("source").alias("_source"),
        F.array_join(F.transform("_row", lambda x: x["target"]), ";").alias("allowed_next_states"),
        json(F.transform("_row", lambda x: x["probability"])).alias("raw_scores"),
        json(probability).alias("normalized_probabilities"),
        F.map_from_entries(F.transform("_row", lambda x: F.struct(x["target"], x["probability"] / F.col("_total")))).alias("_p"),
        normalized_entropy(probability).alias("transition_entropy"),
    )
    # What is sorted is narrow; the wide columns of a state come last, by a broadcast join.
    before = F.lag("event_hash", 1, GENESIS).over(W.partitionBy(key).orderBy("step"))
    told = [key, *carry, "step", "current_state", "proposed_state", "final_state", "dominant_rule"]
    j = steps.select(*dict.fromkeys(told)).withColumn("event_hash", step_hash(key)).withColumn("previous_event_hash", before)
    if posterior is None:
        j = j.withColumn("posterior_entropy", F.lit(None).cast("double"))
    else:
        j = j.join(posterior.select(key, F.col("source").alias("current_state"), F.col("entropy").alias("posterior_entropy")), [key, "current_state"], "left")
    j = j.join(F.broadcast(m), F.col("current_state") == F.col("_source"), "left")  # a row a state
    selected = F.coalesce(F.try_element_at("_p", F.col("proposed_state")), F.lit(0.0)).alias("selected_probability")
    return j.select(key, *carry, "step", "current_state", "allowed_next_states", "raw_scores", "normalized_probabilities", "proposed_state", selected, "transition_entropy", "posterior_entropy", "final_state", F.coalesce("dominant_rule", F.lit("")).alias("safety_override"), "previous_event_hash", "event_hash")


def edge_graph(steps: DataFrame, ordinals: dict[str, int], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes (by, state, ordinal, visits), edges (by, source, target, n, share of the source's steps))."""
    o = F.create_map(*[F.lit(x) for kv in ordinals.items() for x in kv])
    edges = steps.groupBy(*by, F.col("current_state").alias("source"), F.col("final_state").alias("target")).agg(F.count("*").alias("n"))
    nodes = edges.select(*by, F.explode(F.array("source", "target")).alias("state"), "n").groupBy(*by, "state").agg(F.sum("n").alias("visits"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(*by, "source"))
    return nodes.select(*by, "state", F.coalesce(F.try_element_at(o, F.col("state")), F.lit(-1)).alias("ordinal"), "visits"), edges.withColumn("share", share)
