"""Behavioural receipts, trials, snapshots."""

from pyspark.sql import functions as F

from ..operators import behaviour as beh
from ..operators import snapshots as snap
from ..operators import trials as tr
from . import sqlparts as sq
from .core import adapter, query

adapter("receipts", """
SELECT CAST(event_id AS STRING) AS episode_id, CASE WHEN k % 4 = 0 THEN 'quiet' ELSE 'surfaced' END AS delivery,
       CASE WHEN k % 4 = 0 THEN k % 8 = 4 ELSE k % 5 <> 0 END AS consulted,
       CASE WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 0 THEN 'ignored' ELSE 'correct_quiet_negative' END
            ELSE CASE event_type WHEN 'click' THEN 'changed_next_action' WHEN 'view' THEN 'useful_same_action'
                   WHEN 'error' THEN 'stale_or_wrong_coordinate' WHEN 'signup' THEN 'ignored'
                   ELSE CASE WHEN k % 7 = 0 THEN 'correct_quiet_negative' ELSE 'irrelevant' END END END AS outcome,
       CASE WHEN event_type IN ('click', 'error') OR k % 10 = 1 THEN concat('act', CAST(k AS STRING)) END AS action,
       concat('kind-', CAST(user_id % 12 AS STRING)) AS evidence_kind
FROM {event_keys}
""")


@query("beh_1_receipt_violations", """
SELECT * FROM (SELECT episode_id, delivery, outcome, CASE
    WHEN delivery = 'quiet' THEN CASE WHEN consulted THEN 'quiet_consulted' WHEN outcome <> 'correct_quiet_negative' THEN 'quiet_outcome'
                                      WHEN action IS NOT NULL THEN 'quiet_action' END
    WHEN outcome = 'correct_quiet_negative' THEN 'surfaced_quiet_outcome'
    WHEN outcome = 'ignored' THEN CASE WHEN consulted THEN 'ignored_consulted' WHEN action IS NOT NULL THEN 'ignored_action' END
    WHEN NOT consulted THEN 'outcome_needs_consultation'
    WHEN outcome IN ('changed_next_action', 'stale_or_wrong_coordinate') AND action IS NULL THEN 'outcome_needs_action'
    WHEN outcome IN ('useful_same_action', 'irrelevant') AND action IS NOT NULL THEN 'outcome_forbids_action' END AS reason
  FROM {receipts}) v WHERE reason IS NOT NULL
""")
def _(t):
    return beh.receipt_violations(t("receipts"))


COUNTS = """count(*) AS episodes, count(*) FILTER (WHERE delivery = 'surfaced') AS surfaced,
  count(*) FILTER (WHERE delivery = 'quiet') AS quiet, count(*) FILTER (WHERE consulted) AS consulted"""


@query("beh_2_summary", f"""
SELECT 'total' AS "grouping", NULL AS key, {COUNTS} FROM {{receipts}}
UNION ALL SELECT 'outcome', outcome, {COUNTS} FROM {{receipts}} GROUP BY outcome
UNION ALL SELECT 'evidence_kind', evidence_kind, {COUNTS} FROM {{receipts}} GROUP BY evidence_kind
""")
def _(t):
    return beh.behavior_summary(t("receipts"))


@query("beh_2_members", """
SELECT 'outcome' AS "grouping", outcome AS key, episode_id FROM {receipts}
UNION ALL SELECT 'evidence_kind', evidence_kind, episode_id FROM {receipts}
""")
def _(t):
    return beh.behavior_members(t("receipts"))


# One trial per conversation turn; its text is the treatment context.
adapter("trial_plans", """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS trial_id, concat('Task for ', role) AS task_instruction,
       'control' AS control_context, text AS treatment_context,
       concat('a', CAST(turn AS STRING)) AS action_id, concat('Act ', role) AS action_label
FROM {conversations}
""")


def _plans(t):
    actions = F.array(
        F.struct(F.col("action_id").alias("id"), F.col("action_label").alias("label")),
        F.struct(F.lit("stop").alias("id"), F.lit("Stop").alias("label")),
    )
    return t("trial_plans").withColumn("actions", actions)


ACTIONS = f"concat({sq.digest('action_id', 'action_label')}, ',', {sq.digest(repr('stop'), repr('Stop'))})"
CTX = lambda c: sq.digest(f"'{tr.CONTEXT_VERSION}'", c)
FINGERPRINTS = f"""
SELECT trial_id, plan_fingerprint, {CTX('control_context')} AS control_context_digest, {CTX('treatment_context')} AS treatment_context_digest,
  {sq.digest(repr(tr.PACKET_VERSION), 'plan_fingerprint', 'task_instruction', 'actions', 'control_context', CTX('control_context'))} AS control_packet,
  {sq.digest(repr(tr.PACKET_VERSION), 'plan_fingerprint', 'task_instruction', 'actions', 'treatment_context', CTX('treatment_context'))} AS treatment_packet
FROM (SELECT *, {sq.digest(repr(tr.PLAN_VERSION), 'trial_id', 'task_instruction', '2', 'actions', CTX('control_context'), CTX('treatment_context'))} AS plan_fingerprint
      FROM (SELECT *, {ACTIONS} AS actions FROM {{trial_plans}}) p) q
"""


@query("trial_1_fingerprints", FINGERPRINTS)
def _(t):
    return tr.trial_fingerprints(_plans(t))


# The arm each observation claims; turned into packet fingerprints by joining the plans.
adapter("trial_claims", """
SELECT trial_id, 'control' AS arm, action_id AS first_action FROM {trial_plans} WHERE length(treatment_context) % 7 <> 0
UNION ALL
SELECT trial_id, 'treatment' AS arm, CASE WHEN length(treatment_context) % 2 = 0 THEN action_id ELSE 'stop' END AS first_action
FROM {trial_plans} WHERE length(treatment_context) % 5 <> 0
UNION ALL
SELECT trial_id, CASE WHEN length(treatment_context) % 22 = 0 THEN 'control' ELSE 'other' END AS arm, 'stop' AS first_action
FROM {trial_plans} WHERE length(treatment_context) % 11 = 0
""")


@query("trial_2_pairs", """
WITH n AS (SELECT p.trial_id, count(*) FILTER (WHERE c.arm = 'control') AS c, count(*) FILTER (WHERE c.arm = 'treatment') AS t,
                  count(*) FILTER (WHERE c.arm = 'other') AS o,
                  max(CASE WHEN c.arm = 'control' THEN c.first_action END) AS ca, max(CASE WHEN c.arm = 'treatment' THEN c.first_action END) AS ta
           FROM {trial_plans} p LEFT JOIN {trial_claims} c ON c.trial_id = p.trial_id GROUP BY p.trial_id),
s AS (SELECT *, CASE WHEN o > 0 THEN 'unknown_packet' WHEN c > 1 OR t > 1 THEN 'duplicate_arm' WHEN c = 0 THEN 'missing_control'
                     WHEN t = 0 THEN 'missing_treatment' ELSE 'evaluated' END AS status FROM n)
SELECT trial_id, status, CASE WHEN status = 'evaluated' THEN ca END AS control_action, CASE WHEN status = 'evaluated' THEN ta END AS treatment_action,
       CASE WHEN status = 'evaluated' THEN ca = ta END AS same_first_action FROM s
""")
def _(t):
    prints = tr.trial_fingerprints(_plans(t))
    packet = (
        F.when(F.col("arm") == "control", F.col("control_packet"))
        .when(F.col("arm") == "treatment", F.col("treatment_packet")).otherwise("none")
    )
    seen = t("trial_claims").join(prints, "trial_id").select("trial_id", packet.alias("packet_fingerprint"), "first_action")
    return tr.trial_pairs(prints, seen)


# Two runs per order, perturbed so that every confound occurs.
RUN = """
SELECT concat('p', CAST(o_orderkey AS STRING)) AS pair_id, concat('run-', CAST(o_orderkey AS STRING), '-{n}') AS run_id,
       {seq} AS sequence_index, concat('trial-', CAST(o_custkey AS STRING)) AS trial_id,
       CASE WHEN o_orderkey % 37 = 0 THEN 'control' ELSE '{arm}' END AS arm,
       CASE WHEN o_orderkey % 37 = 0 THEN 'without' ELSE '{cond}' END AS condition_id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'w{n}' ELSE 'w' END AS worker_identity,
       CASE WHEN o_orderkey % 11 = 0 THEN 'h{n}' ELSE 'h' END AS harness_identity,
       CASE WHEN o_orderkey % 13 = 0 THEN 'a{n}' ELSE 'a' END AS affordance_identity,
       CASE WHEN o_orderkey % 17 = 0 THEN 's{n}' ELSE 's' END AS sampling_config,
       NOT (o_orderkey % 19 = 0) AS fresh_session, o_orderkey % 23 = {n} AS prior_condition_exposure,
       CASE WHEN o_orderkey % 29 = 0 THEN 'same' ELSE concat('sess-', CAST(o_orderkey AS STRING), '-{n}') END AS session_id,
       CASE WHEN o_orderkey % 31 = 0 THEN 'same' ELSE 'f{n}' END AS freshness_receipt,
       CASE WHEN o_orderkey % 41 = 0 THEN 'same' ELSE 'ref{n}' END AS worker_ref,
       concat('spec-', CAST(o_custkey % 5 AS STRING)) AS trial_spec, concat('repo-', CAST(o_custkey % 3 AS STRING)) AS repository,
       CASE WHEN o_orderkey % 43 = {n} THEN 'moved' ELSE 'rev' END AS revision, 'src/a.rs' AS target_path, 'blob' AS target_blob, 'task' AS task,
       CASE WHEN o_orderkey % 47 = {n} THEN 'other' ELSE 'patch' END AS patch, 'contract' AS completion_contract,
       CASE WHEN o_orderkey % 53 = {n} THEN 'pk-x' ELSE concat('pk-', CASE WHEN o_orderkey % 37 = 0 THEN 'without' ELSE '{cond}' END) END AS packet,
       CASE {outcome} WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'correct_escalation' END AS outcome
FROM ORDERS
"""


def _run(n, seq, arm, cond, outcome):
    text = RUN
    for name, value in {"n": n, "seq": seq, "arm": arm, "cond": cond, "outcome": outcome}.items():
        text = text.replace("{" + name + "}", str(value))
    return text.replace("ORDERS", "{orders}")


adapter("trial_runs",
        _run(1, "CASE WHEN o_orderkey % 59 = 0 THEN 2 ELSE 1 END", "control", "without", "o_orderstatus")
        + "UNION ALL" + _run(2, "2", "treatment", "with", "CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE 'O' END")
        + "WHERE o_orderkey % 61 <> 0")

DRIFT = lambda c: f"count(DISTINCT {c}) > 1"
FLAGS = [
    ("same_arm", "count(DISTINCT arm) = 1"), ("worker_identity_drift", DRIFT("worker_identity")),
    ("harness_identity_drift", DRIFT("harness_identity")), ("affordance_identity_drift", DRIFT("affordance_identity")),
    ("sampling_config_drift", DRIFT("sampling_config")), ("non_fresh_session", "count(*) FILTER (WHERE NOT fresh_session) > 0"),
    ("prior_condition_exposure", "count(*) FILTER (WHERE prior_condition_exposure) > 0"),
    ("reused_session_id", "count(DISTINCT session_id) = 1"), ("reused_freshness_receipt", "count(DISTINCT freshness_receipt) = 1"),
    ("reused_worker_ref", "count(DISTINCT worker_ref) = 1"),
    ("invalid_sequence_coverage", "count(*) FILTER (WHERE sequence_index = 1) = 0 OR count(*) FILTER (WHERE sequence_index = 2) = 0"),
]


@query("trial_3_pair_admission", f"""
WITH g AS (SELECT pair_id, count(*) AS runs, {", ".join(f"({e}) AS {n}" for n, e in FLAGS)} FROM {{trial_runs}} GROUP BY pair_id),
r AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {n} THEN '{n}' END" for n, _ in FLAGS)}) AS reasons FROM g)
SELECT pair_id, runs, reasons, NOT same_arm AS distinct_arm_coverage,
       NOT (worker_identity_drift OR harness_identity_drift OR affordance_identity_drift OR sampling_config_drift) AS frozen_identity_match,
       NOT (non_fresh_session OR prior_condition_exposure OR reused_session_id OR reused_freshness_receipt OR reused_worker_ref OR invalid_sequence_coverage) AS fresh_uncontaminated_sessions,
       CASE WHEN runs <> 2 THEN 'rejected' WHEN same_arm THEN 'invalid_pair' WHEN reasons = '' THEN 'admitted' ELSE 'confounded' END AS verdict
FROM r
""")
def _(t):
    return tr.pair_admission(t("trial_runs")).withColumn("reasons", F.array_join("reasons", ","))


adapter("trial_conditions", """
SELECT concat('trial-', CAST(c_custkey AS STRING)) AS trial_id, 'without' AS condition_id, false AS decisive_evidence_present,
       concat('pk-', 'without') AS packet, 'plain' AS packet_kind, 100 AS budget_bytes, CAST(NULL AS STRING) AS scope FROM {customer}
UNION ALL
SELECT concat('trial-', CAST(c_custkey AS STRING)) AS trial_id, 'with' AS condition_id, c_custkey % 27 <> 0 AS decisive_evidence_present,
       concat('pk-', 'with') AS packet, 'selected' AS packet_kind, 200 AS budget_bytes, 'src' AS scope FROM {customer} WHERE c_custkey % 50 <> 0
""")


@query("trial_4_demand_retirement", f"""
WITH x AS (SELECT r.*, c.decisive_evidence_present AS present, c.condition_id IS NULL AS unknown FROM {{trial_runs}} r
           LEFT JOIN {{trial_conditions}} c ON c.trial_id = r.trial_id AND c.condition_id = r.condition_id),
g AS (SELECT pair_id, count(*) AS runs,
        NOT ({" OR ".join(DRIFT(c) for c in tr.FROZEN)}) AS frozen_identity_match,
        count(*) FILTER (WHERE NOT fresh_session OR prior_condition_exposure) = 0 AND count(DISTINCT session_id) > 1 AND count(DISTINCT run_id) > 1
          AND count(*) FILTER (WHERE sequence_index = 1) > 0 AND count(*) FILTER (WHERE sequence_index = 2) > 0 AS fresh_uncontaminated_sessions,
        count(DISTINCT present) = 2 AND count(DISTINCT condition_id) > 1 AS decisive_evidence_flip, count(*) FILTER (WHERE unknown) AS unknown_conditions,
        max(CASE WHEN NOT present THEN condition_id END) AS bc, max(CASE WHEN present THEN condition_id END) AS tc,
        max(CASE WHEN NOT present THEN outcome END) AS bo, max(CASE WHEN present THEN outcome END) AS "to"
      FROM x GROUP BY pair_id)
SELECT pair_id, unknown_conditions, frozen_identity_match, fresh_uncontaminated_sessions, decisive_evidence_flip,
       CASE WHEN decisive_evidence_flip THEN bc END AS baseline_condition, CASE WHEN decisive_evidence_flip THEN tc END AS treatment_condition,
       CASE WHEN decisive_evidence_flip THEN bo END AS baseline_outcome, CASE WHEN decisive_evidence_flip THEN "to" END AS treatment_outcome,
       CASE WHEN unknown_conditions > 0 THEN 'unknown_condition' WHEN runs <> 2 THEN 'rejected' WHEN NOT frozen_identity_match OR NOT fresh_uncontaminated_sessions THEN 'confounded'
            WHEN NOT decisive_evidence_flip THEN 'invalid_evidence_pair'
            WHEN bo = 'failed' AND "to" = 'success' THEN 'paired_retirement_signal'
            WHEN bo = 'correct_escalation' AND "to" = 'success' THEN 'correct_escalation_then_success'
            WHEN bo = 'success' THEN 'no_demand_observed' ELSE 'demand_persists' END AS verdict
FROM g
""")
def _(t):
    return tr.demand_retirement(t("trial_runs"), t("trial_conditions"))


adapter("trial_manifests", """
SELECT concat('trial-', CAST(c_custkey AS STRING)) AS trial_id, concat('spec-', CAST(c_custkey % 5 AS STRING)) AS trial_spec,
       concat('repo-', CAST(c_custkey % 3 AS STRING)) AS repository, 'rev' AS revision, 'src/a.rs' AS target_path, 'blob' AS target_blob,
       'task' AS task, 'patch' AS patch, 'contract' AS completion_contract
FROM {customer} WHERE c_custkey % 33 <> 0
""")


@query("trial_5_run_violations", """
SELECT * FROM (
  SELECT r.run_id, r.trial_id, r.condition_id,
         CASE WHEN m.trial_id IS NULL THEN 'unknown_trial'
              WHEN r.trial_spec <> m.trial_spec OR r.repository <> m.repository OR r.revision <> m.revision THEN 'coordinate_mismatch'
              WHEN r.task <> m.task OR r.patch <> m.patch OR r.completion_contract <> m.completion_contract THEN 'fingerprint_mismatch'
              WHEN c.trial_id IS NULL THEN 'unknown_condition' WHEN r.packet <> c.packet THEN 'packet_mismatch' END AS reason
  FROM {trial_runs} r LEFT JOIN {trial_manifests} m ON m.trial_id = r.trial_id
  LEFT JOIN {trial_conditions} c ON c.trial_id = r.trial_id AND c.condition_id = r.condition_id) v WHERE reason IS NOT NULL
""")
def _(t):
    return tr.run_violations(t("trial_runs"), t("trial_manifests"), t("trial_conditions"))


adapter("spec_conditions", """
SELECT trial_id, condition_id, decisive_evidence_present, packet_kind, budget_bytes + CASE WHEN trial_id LIKE '%7' THEN 1 ELSE 0 END AS budget_bytes,
       CASE WHEN trial_id LIKE '%8' THEN NULL ELSE scope END AS scope
FROM {trial_conditions} WHERE NOT (trial_id LIKE '%9' AND condition_id = 'with')
UNION ALL
SELECT concat('trial-', CAST(c_custkey AS STRING)), 'with', true, 'selected', 200, 'src' FROM {customer} WHERE c_custkey % 50 = 0
""")


@query("trial_5_manifest_drift", """
SELECT * FROM (
  SELECT coalesce(s.trial_id, m.trial_id) AS trial_id, coalesce(s.condition_id, m.condition_id) AS condition_id,
         CASE WHEN m.trial_id IS NULL THEN 'missing_condition' WHEN s.trial_id IS NULL THEN 'undeclared_condition'
              WHEN s.packet_kind <> m.packet_kind OR s.budget_bytes <> m.budget_bytes OR s.scope IS DISTINCT FROM m.scope THEN 'recipe_drift'
              WHEN s.decisive_evidence_present <> m.decisive_evidence_present THEN 'evidence_drift' END AS reason
  FROM {spec_conditions} s FULL JOIN {trial_conditions} m ON m.trial_id = s.trial_id AND m.condition_id = s.condition_id) v
WHERE reason IS NOT NULL
""")
def _(t):
    return tr.manifest_drift(t("spec_conditions"), t("trial_conditions"))


adapter("order_pairs", "SELECT concat('p', CAST(o_orderkey AS STRING)) AS pair_id FROM {orders}")


@query("trial_6_assign_order", """
SELECT pair_id, CASE WHEN substr(sha256(concat('seed-1', chr(0), pair_id)), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 'ba' ELSE 'ab' END AS "order"
FROM {order_pairs}
""")
def _(t):
    return tr.assign_order(t("order_pairs"), "seed-1")


adapter("episode_facts", """
SELECT CAST(event_id AS STRING) AS episode_id, event_id % 6 = 0 AS contract_satisfied, k % 17 <> 0 AS specification_complete,
       k % 5 <> 0 AS evidence_required, k % 13 <> 0 AS evidence_available, k % 11 <> 0 AS evidence_valid, k % 3 <> 0 AS evidence_selected,
       event_id % 2 = 0 AS evidence_recovered, k % 7 <> 0 AS evidence_inspected,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 9 <> 1 END AS interpretation_matches,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 11 <> 1 END AS plan_matches,
       event_id % 13 <> 0 AS affordance_available, event_id % 7 <> 0 AS implementation_completed, event_id % 5 <> 0 AS validation_completed,
       user_id % 2 = 0 AS reported_complete, user_id % 3 = 0 AS requested_discriminator
FROM {event_keys}
""")


def _ladder(selected):
    return f"""CASE WHEN contract_satisfied THEN 'none' WHEN NOT specification_complete THEN 'specification_gap'
  WHEN evidence_required AND NOT evidence_available THEN 'evidence_absent' WHEN evidence_required AND NOT evidence_valid THEN 'evidence_misrepresented'
  WHEN evidence_required AND NOT {selected} THEN 'selection_miss' WHEN evidence_required AND NOT evidence_inspected THEN 'attention_miss'
  WHEN NOT interpretation_matches THEN 'interpretation_miss' WHEN NOT plan_matches THEN 'planning_miss'
  WHEN NOT affordance_available THEN 'affordance_miss' WHEN NOT implementation_completed THEN 'execution_miss'
  WHEN NOT validation_completed THEN 'validation_miss' WHEN reported_complete THEN 'completion_contract_miss' ELSE 'unexplained' END"""


BOUNDARIES = f"""
SELECT episode_id, boundary,
       CASE WHEN boundary = 'none' THEN 'success'
            WHEN requested_discriminator AND boundary IN ('specification_gap', 'evidence_absent', 'selection_miss', 'affordance_miss') THEN 'correct_escalation'
            ELSE 'failed' END AS response,
       CASE WHEN boundary = 'selection_miss' AND evidence_recovered AND behind NOT IN ('none', 'unexplained') THEN behind END AS downstream
FROM (SELECT *, {_ladder('evidence_selected')} AS boundary, {_ladder('true')} AS behind FROM {{episode_facts}}) b
"""


@query("trial_7_failure_boundaries", BOUNDARIES)
def _(t):
    return tr.failure_boundaries(t("episode_facts"))


@query("trial_7_boundary_counts", f"SELECT boundary, response, downstream, count(*) AS episodes FROM ({BOUNDARIES}) x GROUP BY ALL")
def _(t):
    return tr.boundary_counts(tr.failure_boundaries(t("episode_facts")))


PATH_SETS = sq.bag("{work_paths}", "snapshot_id, id", "sha256(path)", "paths/1", "b")
ITEMS = f"""(SELECT a.snapshot_id, {sq.digest('a.id', 'lower(a.head_sha)', 'a.activity', 'p.b')} AS d FROM {{work_items}} a
             LEFT JOIN ({PATH_SETS}) p ON p.snapshot_id = a.snapshot_id AND p.id = a.id)"""
LINKS = f"(SELECT DISTINCT snapshot_id, {sq.digest('kind', 'from_id', 'to_id')} AS d FROM {{coordination_edges}})"
WORK_FACT = f"""
SELECT w.snapshot_id, {sq.digest(repr(snap.WORK_FACT_VERSION), 'w.b', 'e.b')} AS work_fact_identity
FROM ({sq.bag(ITEMS, 'snapshot_id', 'd', 'work/1', 'b')}) w LEFT JOIN ({sq.bag(LINKS, 'snapshot_id', 'd', 'edges/1', 'b')}) e ON e.snapshot_id = w.snapshot_id
"""


@query("snap_1_work_fact_identity", WORK_FACT)
def _(t):
    return snap.work_fact_identity(t("work_items"), t("work_paths"), t("coordination_edges"))


adapter("selection_rows", """
SELECT CAST(c_custkey AS STRING) AS selection_id, 'hosted' AS provider_kind, CASE WHEN c_custkey % 2 = 0 THEN 'Host.Example' ELSE 'host.example' END AS provider_instance,
       concat('Owner/', c_mktsegment) AS collection, 'pull_request' AS work_kind,
       'open' AS state1, CASE WHEN c_custkey % 9 = 0 THEN 'open' ELSE 'closed' END AS state2, CASE WHEN c_nationkey % 2 = 0 THEN 'include' ELSE 'exclude' END AS draft_policy,
       CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 14 = 1 THEN 0 ELSE 100 END AS max_items, 'updated' AS order_field, 'desc' AS order_direction,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN NULL ELSE 'number' END AS tie_break, c_custkey % 100 + 1 AS page_size
FROM {customer}
""")


def _selections(t):
    return t("selection_rows").withColumn("states", F.array("state2", "state1"))


SELECTION = f"""
SELECT selection_id, rejection, CASE WHEN rejection IS NULL THEN {sq.digest(repr(snap.SELECTION_VERSION), 'provider_kind', 'lower(provider_instance)', 'lower(collection)',
    'work_kind', repr('closed,open'), 'draft_policy', 'max_items', 'CASE WHEN max_items IS NOT NULL THEN order_field END',
    'CASE WHEN max_items IS NOT NULL THEN order_direction END', 'tie_break')} END AS selection_identity
FROM (SELECT *, CASE WHEN state1 = state2 THEN 'duplicate_state' WHEN max_items < 1 THEN 'empty_bound'
                     WHEN max_items IS NOT NULL AND tie_break IS NULL THEN 'bounded_without_tie_break'
                     WHEN max_items IS NULL AND tie_break IS NOT NULL THEN 'exhaustive_with_tie_break' END AS rejection FROM {{selection_rows}}) s
"""


@query("snap_2_selection_identity", SELECTION)
def _(t):
    return snap.selection_identity(_selections(t))


adapter("composed", "SELECT CAST(c_custkey AS STRING) AS selection_id, CAST(c_custkey % 55 AS STRING) AS snapshot_id FROM {customer}")


@query("snap_2_snapshot_identity", f"""
SELECT c.selection_id, c.snapshot_id, CASE WHEN s.selection_identity IS NOT NULL AND w.work_fact_identity IS NOT NULL
    THEN concat('sha256:', {sq.digest(repr(snap.SNAPSHOT_VERSION), 's.selection_identity', 'w.work_fact_identity')}) END AS snapshot_identity
FROM {{composed}} c LEFT JOIN ({SELECTION}) s ON s.selection_id = c.selection_id LEFT JOIN ({WORK_FACT}) w ON w.snapshot_id = c.snapshot_id
""")
def _(t):
    facts = snap.work_fact_identity(t("work_items"), t("work_paths"), t("coordination_edges"))
    return snap.snapshot_identity(snap.selection_identity(_selections(t)), facts, t("composed"))


adapter("finding_rows", """
SELECT CAST(user_id AS STRING) AS snapshot_id, event_id AS position, event_type AS kind, concat('src/', CAST(k % 20 AS STRING), '.rs') AS target,
       concat('message ', CAST(k AS STRING)) AS message, k % 50 = 0 AS resolved
FROM {event_keys}
""")
adapter("delta_rows", """
SELECT CAST(c_custkey AS STRING) AS snapshot_id, CASE WHEN c_nationkey % 2 = 0 THEN 'error' ELSE 'click' END AS kind,
       concat('src/', CAST(c_nationkey % 22 AS STRING), '.rs') AS target, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'stale' ELSE 'current' END AS base_state
FROM {customer}
""")
PRINT = f"""SELECT snapshot_id, fingerprint FROM (
  {sq.bag("{finding_rows}", "snapshot_id", sq.digest('position', 'kind', 'target', 'message', 'CAST(resolved AS VARCHAR)'), snap.FINDINGS_VERSION, "fingerprint")}) f"""


def _deltas(t):
    # A delta made against the present state carries its fingerprint.
    now = snap.findings_fingerprint(t("finding_rows"))
    base = F.when(F.col("base_state") == "current", F.col("fingerprint")).otherwise(F.col("base_state"))
    return t("delta_rows").join(now, "snapshot_id", "left").select("snapshot_id", "kind", "target", base.alias("base"))


RECEIPTS = f"""
SELECT d.snapshot_id, d.kind, d.target,
       CASE WHEN d.base_state = 'stale' THEN 'base_mismatch'
            WHEN NOT EXISTS (SELECT 1 FROM {{finding_rows}} f WHERE f.snapshot_id = d.snapshot_id AND f.kind = d.kind AND f.target = d.target) THEN 'missing_target'
            ELSE 'applied' END AS status
FROM {{delta_rows}} d
"""


@query("snap_3_findings_fingerprint", PRINT)
def _(t):
    return snap.findings_fingerprint(t("finding_rows"))


@query("snap_3_delta_receipts", RECEIPTS)
def _(t):
    return snap.delta_receipts(t("finding_rows"), _deltas(t))


@query("snap_3_apply_deltas", f"""
WITH r AS ({RECEIPTS})
SELECT f.snapshot_id, f.position, f.kind, f.target, f.message,
       f.resolved OR (f.position = min(f.position) OVER (PARTITION BY f.snapshot_id, f.kind, f.target)
                      AND EXISTS (SELECT 1 FROM r WHERE r.status = 'applied' AND r.snapshot_id = f.snapshot_id AND r.kind = f.kind AND r.target = f.target)) AS resolved
FROM {{finding_rows}} f
""")
def _(t):
    return snap.apply_deltas(t("finding_rows"), _deltas(t))
