"""Probe planning, observations and refinement."""

from pyspark.sql import functions as F

from ..operators import observations as obs
from ..operators import planning as plan
from ..operators import refinement as ref
from .core import adapter, query
from .evidence import REQ, SAME

adapter("probes", """
SELECT o.obligation_id, concat(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING)) AS probe_id,
       o.missing_kind AS kind, CASE WHEN l.l_quantity >= 6 OR l.l_linenumber = 1 THEN 'other' ELSE o.missing_target END AS target,
       o.repository, CASE WHEN l.l_linenumber = 2 THEN 'v9' WHEN l.l_linenumber % 3 = 0 THEN 'v0' ELSE o.revision END AS revision,
       CASE WHEN l.l_linenumber % 3 = 0 THEN 'w1' ELSE o.work END AS work, o.scope_mode, o.scope_path,
       CASE l.l_returnflag WHEN 'A' THEN 'effectful' WHEN 'N' THEN 'read_only' ELSE 'external_read' END AS effect,
       l.l_suppkey % 4 AS git_subprocesses, l.l_suppkey % 6 AS files_parsed,
       CASE l.l_returnflag WHEN 'N' THEN l.l_orderkey % 29 - l.l_orderkey % 29 + CASE WHEN l.l_orderkey % 29 = 0 THEN 1 ELSE 0 END
                           ELSE l.l_suppkey % 3 END AS remote_requests,
       CASE WHEN l.l_returnflag = 'A' THEN l.l_suppkey % 5 WHEN l.l_orderkey % 31 = 0 THEN 1 ELSE 0 END
         + CASE WHEN l.l_orderkey % 997 = 0 THEN 2000000 ELSE 0 END AS effectful_executions
FROM {lineitem} l JOIN {obligations} o ON CAST(l.l_partkey AS STRING) = o.obligation_id
""")

CANDIDATES = f"""
SELECT r.obligation_id, r.probe_id,
       CASE WHEN r.kind <> o.missing_kind OR r.target <> o.missing_target THEN 'incapable'
            WHEN NOT EXISTS (SELECT 1 FROM {{conditions}} c WHERE {SAME}) THEN 'incompatible_clearing_condition'
            ELSE CASE {REQ('r')} WHEN 'invalid' THEN 'invalid_coordinate' WHEN 'unknown' THEN 'missing_context'
                 ELSE CASE WHEN r.effect = 'effectful' THEN 'effect_authority_required' ELSE 'eligible' END END END AS status,
       r.effect, r.remote_requests, r.git_subprocesses, r.files_parsed, r.effectful_executions
FROM {{probes}} r JOIN {{obligations}} o ON r.obligation_id = o.obligation_id
LEFT JOIN {{obligation_contexts}} x ON o.context_set = x.context_set
WHERE {REQ('o')} <> 'invalid'
"""


def _candidates(t):
    return plan.probe_candidates(t("obligations"), t("conditions"), t("probes"), t("obligation_contexts"))


@query("plan_1_probe_candidates", CANDIDATES)
def _(t):
    return _candidates(t)


@query("plan_2_probe_plans", f"""
WITH c AS ({CANDIDATES}),
r AS (SELECT *, row_number() OVER (PARTITION BY obligation_id ORDER BY
        CASE effect WHEN 'read_only' THEN 0 WHEN 'external_read' THEN 1 ELSE 2 END,
        remote_requests, git_subprocesses, files_parsed, effectful_executions, probe_id) AS rn
      FROM c WHERE status = 'eligible'),
g AS (SELECT obligation_id, count(*) AS candidates, bool_or(status IN ('missing_context', 'effect_authority_required')) AS blocked
      FROM c GROUP BY obligation_id)
SELECT o.obligation_id, r.probe_id AS selected, coalesce(g.candidates, 0) AS candidates,
       CASE WHEN {REQ('o')} = 'invalid' THEN 'stale_obligation' WHEN r.probe_id IS NOT NULL THEN 'selected'
            WHEN {REQ('o')} = 'unknown' OR coalesce(g.blocked, false) THEN 'blocked' ELSE 'unresolved' END AS status
FROM {{obligations}} o LEFT JOIN {{obligation_contexts}} x ON o.context_set = x.context_set
LEFT JOIN g ON g.obligation_id = o.obligation_id LEFT JOIN r ON r.obligation_id = o.obligation_id AND r.rn = 1
""")
def _(t):
    return plan.plan_probes(t("obligations"), t("obligation_contexts"), _candidates(t))


@query("plan_3_cost_violations", """
SELECT obligation_id, probe_id, effect, reason FROM (
  SELECT *, CASE WHEN git_subprocesses > 1000000 OR files_parsed > 1000000 OR remote_requests > 1000000
                      OR effectful_executions > 1000000 THEN 'cost_out_of_range'
    WHEN effect = 'read_only' AND (remote_requests <> 0 OR effectful_executions <> 0) THEN 'read_only_forecasts_outside_work'
    WHEN effect = 'external_read' AND remote_requests = 0 THEN 'external_read_without_request'
    WHEN effect = 'external_read' AND effectful_executions <> 0 THEN 'external_read_forecasts_execution'
    WHEN effect = 'effectful' AND effectful_executions = 0 THEN 'effectful_without_execution' END AS reason
  FROM {probes}) v WHERE reason IS NOT NULL
""")
def _(t):
    return plan.probe_cost_violations(t("probes"))


adapter("observations", """
SELECT CAST(event_id AS STRING) AS observation_id, concat(event_type, CAST(user_id % 20 AS STRING), '-', CAST(event_id % 9 AS STRING)) AS discriminator_id,
       CAST(user_id AS STRING) AS subject_ref,
       CASE WHEN k % 3 <> 0 THEN concat('v', CAST(k % 3 AS STRING)) END AS value_ref,
       CASE WHEN k % 5 = 0 THEN 'invalid' WHEN k % 5 = 1 THEN 'unknown' ELSE 'applies' END AS applicability
FROM {event_keys}
""")
STATE = "CASE WHEN applicability = 'invalid' THEN 'invalid' WHEN applicability = 'unknown' OR value_ref IS NULL THEN 'unknown' ELSE 'current' END"


@query("obs_1_currentness", f"SELECT *, {STATE} AS state FROM {{observations}}")
def _(t):
    return obs.currentness(t("observations"))


@query("obs_2_partitions", f"""
WITH s AS (SELECT *, {STATE} AS state FROM {{observations}})
SELECT discriminator_id, state, CASE WHEN state = 'current' THEN value_ref END AS partition_value, count(*) AS observations,
       min(observation_id) AS first_observation, max(observation_id) AS last_observation
FROM s GROUP BY ALL
""")
def _(t):
    return obs.discriminator_partitions(t("observations"))


@query("obs_2_partition_members", f"""
WITH s AS (SELECT *, {STATE} AS state FROM {{observations}})
SELECT discriminator_id, state, CASE WHEN state = 'current' THEN value_ref END AS partition_value, observation_id, subject_ref FROM s
""")
def _(t):
    return obs.partition_members(t("observations"))


adapter("frontier_requirements", """
SELECT DISTINCT concat(event_type, CAST(user_id % 20 AS STRING), '-', CAST(event_id % 9 AS STRING)) AS discriminator_id,
       CAST(user_id + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS STRING) AS subject_ref
FROM {events} WHERE event_type <> 'view'
""")
adapter("frontiers", f"""
SELECT q.discriminator_id, q.subject_ref, coalesce(a.c, 0) AS current, coalesce(a.u, 0) AS unknown, coalesce(a.i, 0) AS invalid,
       coalesce(d.n, 0) - coalesce(a.n, 0) AS other_subject,
       CASE WHEN a.c > 0 THEN 'current' WHEN a.u > 0 THEN 'unknown' WHEN a.i > 0 THEN 'invalid' ELSE 'missing' END AS status
FROM {{frontier_requirements}} q
LEFT JOIN (SELECT discriminator_id, subject_ref, count(*) AS n,
                  sum(CASE WHEN {STATE} = 'current' THEN 1 ELSE 0 END) AS c,
                  sum(CASE WHEN {STATE} = 'unknown' THEN 1 ELSE 0 END) AS u,
                  sum(CASE WHEN {STATE} = 'invalid' THEN 1 ELSE 0 END) AS i
           FROM {{observations}} GROUP BY discriminator_id, subject_ref) a
  ON a.discriminator_id = q.discriminator_id AND a.subject_ref = q.subject_ref
LEFT JOIN (SELECT discriminator_id, count(*) AS n FROM {{observations}} GROUP BY discriminator_id) d ON d.discriminator_id = q.discriminator_id
""")


@query("obs_3_frontiers", """
SELECT discriminator_id, subject_ref, status, CAST(current AS BIGINT) AS current, CAST(unknown AS BIGINT) AS unknown,
       CAST(invalid AS BIGINT) AS invalid, other_subject,
       CASE status WHEN 'current' THEN 'proceed_bounded' WHEN 'invalid' THEN 'reject_stale' ELSE 'request_discriminator' END AS next_action
FROM {frontiers}
""")
def _(t):
    return obs.frontiers(t("frontier_requirements"), t("observations"))


@query("obs_3_frontier_receipts", f"""
SELECT o.discriminator_id, o.subject_ref, {STATE} AS state, o.observation_id, o.value_ref
FROM {{observations}} o WHERE EXISTS (SELECT 1 FROM {{frontier_requirements}} q
  WHERE q.discriminator_id = o.discriminator_id AND q.subject_ref = o.subject_ref)
""")
def _(t):
    return obs.frontier_receipts(t("frontier_requirements"), t("observations"))


adapter("bridges", """
SELECT concat('b', discriminator_id, '-', subject_ref) AS bridge_id, discriminator_id, subject_ref, subject_ref AS context_set,
       'ci' AS kind, discriminator_id AS target, concat('r', CAST(CAST(subject_ref AS BIGINT) % 5 AS STRING)) AS repository,
       CASE WHEN CAST(subject_ref AS BIGINT) % 2 = 0 THEN 'v1' END AS revision, CAST(NULL AS STRING) AS work,
       CAST(NULL AS STRING) AS scope_mode, CAST(NULL AS STRING) AS scope_path
FROM {frontier_requirements} WHERE CAST(subject_ref AS BIGINT) % 3 <> 0
""")
adapter("bridge_contexts", """
SELECT context_set, repository, revision, work, path FROM {contexts} WHERE context_id = 'after'
""")
adapter("bridge_probes", """
SELECT b.bridge_id, concat('p', CAST(e.event_id AS STRING)) AS probe_id, b.kind,
       CASE WHEN e.k % 6 = 0 THEN 'other' ELSE b.target END AS target, b.repository, b.revision, b.work, b.scope_mode, b.scope_path,
       CASE e.k % 3 WHEN 0 THEN 'effectful' WHEN 1 THEN 'read_only' ELSE 'external_read' END AS effect,
       e.k % 4 AS git_subprocesses, e.k % 7 AS files_parsed, e.k % 2 AS remote_requests, e.k % 5 AS effectful_executions
FROM {event_keys} e JOIN {bridges} b
  ON b.discriminator_id = concat(e.event_type, CAST(e.user_id % 20 AS STRING), '-', CAST(e.event_id % 9 AS STRING)) AND b.subject_ref = CAST(e.user_id AS STRING)
""")


@query("plan_4_observation_probes", f"""
WITH need AS (SELECT b.* FROM {{bridges}} b JOIN {{frontiers}} f ON b.discriminator_id = f.discriminator_id
              AND b.subject_ref = f.subject_ref AND f.status <> 'current'),
o AS (SELECT b.*, {REQ('b')} AS subject FROM need b LEFT JOIN {{bridge_contexts}} x ON b.context_set = x.context_set),
c AS (SELECT p.*, CASE WHEN p.kind <> o.kind OR p.target <> o.target THEN 'incapable'
                       WHEN o.subject = 'unknown' THEN 'missing_context'
                       WHEN p.effect = 'effectful' THEN 'effect_authority_required' ELSE 'eligible' END AS st
      FROM {{bridge_probes}} p JOIN o ON p.bridge_id = o.bridge_id WHERE o.subject <> 'invalid'),
r AS (SELECT *, row_number() OVER (PARTITION BY bridge_id ORDER BY CASE effect WHEN 'read_only' THEN 0 ELSE 1 END,
        remote_requests, git_subprocesses, files_parsed, effectful_executions, probe_id) AS rn FROM c WHERE st = 'eligible'),
g AS (SELECT bridge_id, bool_or(st IN ('missing_context', 'effect_authority_required')) AS blocked FROM c GROUP BY bridge_id)
SELECT f.discriminator_id, f.subject_ref, f.status AS frontier_status, o.bridge_id, r.probe_id AS selected,
       CASE WHEN f.status = 'current' THEN 'already_current' WHEN o.bridge_id IS NULL THEN 'no_admitted_mapping' ELSE 'planned' END AS status,
       CASE WHEN o.bridge_id IS NULL THEN NULL WHEN o.subject = 'invalid' THEN 'stale_obligation' WHEN r.probe_id IS NOT NULL THEN 'selected'
            WHEN o.subject = 'unknown' OR coalesce(g.blocked, false) THEN 'blocked' ELSE 'unresolved' END AS plan_status
FROM {{frontiers}} f LEFT JOIN o ON o.discriminator_id = f.discriminator_id AND o.subject_ref = f.subject_ref
LEFT JOIN g ON g.bridge_id = o.bridge_id LEFT JOIN r ON r.bridge_id = o.bridge_id AND r.rn = 1
""")
def _(t):
    rows = obs.frontiers(t("frontier_requirements"), t("observations"))
    return plan.plan_observation_probes(rows, t("bridges"), t("bridge_probes"), t("bridge_contexts"))


# Cohorts of line items per supplier; facts as columns for SQL, as a map for the operator.
adapter("cohort_facts", """
SELECT CAST(l_suppkey AS STRING) AS cohort_id, CASE WHEN l_returnflag <> 'R' THEN 'support' ELSE 'counterexample' END AS outcome,
       CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN l_returnflag = 'R' AND l_quantity > 5 THEN 'O' ELSE 'F' END ELSE l_linestatus END AS linestatus,
       CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS linenumber,
       CASE WHEN l_tax >= 0 THEN 'same' END AS taxed,
       CASE WHEN l_returnflag = 'A' AND l_quantity < 3 THEN 'rare' ELSE 'usual' END AS shape
FROM {lineitem}
""")
adapter("discriminators", """
SELECT CAST(s_suppkey AS STRING) AS cohort_id, 'linestatus' AS discriminator FROM {supplier}
UNION ALL SELECT CAST(s_suppkey AS STRING), 'linenumber' FROM {supplier}
UNION ALL SELECT CAST(s_suppkey AS STRING), 'taxed' FROM {supplier}
UNION ALL SELECT CAST(s_suppkey AS STRING), 'shape' FROM {supplier}
""")
adapter("current_values", """
SELECT CAST(s_suppkey AS STRING) AS cohort_id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'F' END AS linestatus,
       '2' AS linenumber, 'same' AS taxed, CASE WHEN s_suppkey % 2 = 0 THEN 'rare' ELSE 'absent' END AS shape
FROM {supplier}
""")
LONG = """
SELECT cohort_id, outcome, 'linestatus' AS discriminator, linestatus AS value FROM {cohort_facts}
UNION ALL SELECT cohort_id, outcome, 'linenumber', linenumber FROM {cohort_facts}
UNION ALL SELECT cohort_id, outcome, 'taxed', taxed FROM {cohort_facts}
UNION ALL SELECT cohort_id, outcome, 'shape', shape FROM {cohort_facts}
"""
PARTS = f"""
SELECT cohort_id, discriminator, value, count(*) FILTER (WHERE outcome = 'support') AS support,
       count(*) FILTER (WHERE outcome = 'counterexample') AS counterexamples FROM ({LONG}) l GROUP BY cohort_id, discriminator, value
"""
BASE = """
SELECT cohort_id, count(*) FILTER (WHERE outcome = 'support') AS baseline_support,
       count(*) FILTER (WHERE outcome = 'counterexample') AS baseline_counterexamples FROM {cohort_facts} GROUP BY cohort_id
"""
FACTS = ["linestatus", "linenumber", "taxed", "shape"]


def _as_map(df, *keep):
    # A null value says that the fact is missing.
    return df.select(*keep, F.create_map(*[x for f in FACTS for x in (F.lit(f), F.col(f))]).alias("facts"))


@query("ref_1_cohort_partitions", f"""
SELECT p.*, b.baseline_support, b.baseline_counterexamples FROM ({PARTS}) p JOIN ({BASE}) b ON p.cohort_id = b.cohort_id
""")
def _(t):
    return ref.cohort_partitions(_as_map(t("cohort_facts"), "cohort_id", "outcome"), t("discriminators"))


@query("ref_2_refinements", f"""
WITH p AS ({PARTS}), b AS ({BASE}),
cur AS (SELECT cohort_id, 'linestatus' AS discriminator, linestatus AS v FROM {{current_values}}
        UNION ALL SELECT cohort_id, 'linenumber', linenumber FROM {{current_values}}
        UNION ALL SELECT cohort_id, 'taxed', taxed FROM {{current_values}}
        UNION ALL SELECT cohort_id, 'shape', shape FROM {{current_values}})
SELECT d.cohort_id, d.discriminator, cur.v AS current_value, p.support, p.counterexamples, b.baseline_support, b.baseline_counterexamples,
       b.baseline_support - p.support AS excluded_support, b.baseline_counterexamples - p.counterexamples AS excluded_counterexamples,
       CASE WHEN p.support IS NULL THEN 'unknown_current'
            WHEN coalesce(m.counterexamples, 0) > 0 THEN 'incomplete_evidence'
            WHEN b.baseline_counterexamples = p.counterexamples THEN 'no_improvement'
            WHEN p.support < 20 THEN 'overfit'
            WHEN CAST(p.counterexamples AS HUGEINT) * (b.baseline_support + b.baseline_counterexamples)
                 >= CAST(b.baseline_counterexamples AS HUGEINT) * (p.support + p.counterexamples) THEN 'no_improvement'
            ELSE 'candidate' END AS status
FROM {{discriminators}} d
LEFT JOIN cur ON cur.cohort_id = d.cohort_id AND cur.discriminator = d.discriminator
LEFT JOIN p ON p.cohort_id = d.cohort_id AND p.discriminator = d.discriminator AND p.value = cur.v
LEFT JOIN p m ON m.cohort_id = d.cohort_id AND m.discriminator = d.discriminator AND m.value IS NULL
LEFT JOIN b ON b.cohort_id = d.cohort_id
""")
def _(t):
    return ref.evaluate_refinements(
        _as_map(t("cohort_facts"), "cohort_id", "outcome"), t("discriminators"), _as_map(t("current_values"), "cohort_id"), 20
    )


# An episode per order; its line items are candidate refinements.
adapter("episode_candidates", """
SELECT CAST(l_orderkey AS STRING) AS episode_id, concat('k', CAST(l_linenumber AS STRING)) AS candidate_id,
       concat('d', CAST(l_suppkey % 5 AS STRING)) AS discriminator,
       CASE l_linenumber WHEN 1 THEN 'retained' WHEN 2 THEN 'weakened' WHEN 3 THEN 'split' WHEN 4 THEN 'rejected_no_improvement'
                         WHEN 5 THEN 'rejected_lost_expected_case' ELSE 'rejected_overfit' END AS status,
       min(l_suppkey) % 3 AS resolved, min(l_partkey) % 2 AS lost,
       CASE WHEN min(l_partkey) % 7 = 0 THEN 'failed' ELSE 'passed' END AS held_out
FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_suppkey % 5
""")
adapter("episode_heads", """
SELECT CAST(o_orderkey AS STRING) AS episode_id,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('k', CAST(o_orderkey % 8 AS STRING)) END AS selected_transition
FROM {orders}
""")


@query("ref_3_episode_violations", """
WITH c AS (SELECT e.*, concat(c.candidate_id, '/', c.discriminator) AS id, c.candidate_id, c.discriminator, c.status, c.resolved, c.lost, c.held_out
           FROM {episode_candidates} c JOIN {episode_heads} e ON c.episode_id = e.episode_id),
v AS (
  SELECT episode_id, candidate_id, 'unadmitted_discriminator' AS reason FROM c WHERE discriminator IN ('d3', 'd4')
  UNION ALL SELECT episode_id, candidate_id, 'kept_loses_expected' FROM c WHERE status IN ('retained', 'weakened', 'split') AND lost <> 0
  UNION ALL SELECT episode_id, candidate_id, 'kept_resolves_nothing' FROM c WHERE status IN ('retained', 'weakened', 'split') AND resolved = 0
  UNION ALL SELECT episode_id, candidate_id, 'kept_failed_held_out' FROM c WHERE status IN ('retained', 'weakened', 'split') AND held_out = 'failed'
  UNION ALL SELECT episode_id, candidate_id, 'no_improvement_changes_replay' FROM c WHERE status = 'rejected_no_improvement' AND (resolved <> 0 OR lost <> 0)
  UNION ALL SELECT episode_id, candidate_id, 'lost_case_loses_nothing' FROM c WHERE status = 'rejected_lost_expected_case' AND lost = 0
  UNION ALL SELECT episode_id, candidate_id, 'selected_not_kept' FROM c WHERE candidate_id = selected_transition AND status NOT IN ('retained', 'weakened', 'split'))
SELECT episode_id, candidate_id, reason FROM v
UNION ALL
SELECT e.episode_id, e.selected_transition, 'selected_absent' FROM {episode_heads} e
WHERE e.selected_transition IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.episode_id = e.episode_id)
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.episode_id = e.episode_id AND c.candidate_id = e.selected_transition)
""")
def _(t):
    # An order has a handful of line items, so the nested candidates are bounded.
    nested = t("episode_candidates").groupBy("episode_id").agg(
        F.collect_list(
            F.struct(
                F.col("candidate_id").alias("id"), F.array("discriminator").alias("discriminators"),
                "status", "resolved", "lost", "held_out",
            )
        ).alias("candidates")
    )
    episodes = nested.join(t("episode_heads"), "episode_id").withColumn(
        "admitted", F.array(*[F.lit(f"d{i}") for i in range(3)])
    )
    return ref.refinement_violations(episodes)
