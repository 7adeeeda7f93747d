"""Applicability, justification, obligations."""

from pyspark.sql import functions as F

from ..operators import applicability as app
from ..operators import justification as just
from ..operators import obligations as obl
from .core import adapter, query

adapter("event_keys", """
SELECT event_id, user_id, ts, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM {events}
""")

adapter("evidence", """
SELECT CAST(event_id AS STRING) AS evidence_id, CAST(user_id AS STRING) AS context_set,
       CASE WHEN k % 12 = 0 THEN NULL ELSE concat('r', CAST(user_id % 5 AS STRING)) END AS repository,
       CASE WHEN k % 4 = 0 THEN NULL ELSE concat('v', CAST(k % 4 AS STRING)) END AS revision,
       CASE WHEN k % 6 = 1 THEN concat('w', CAST(k % 2 AS STRING)) END AS work,
       CASE WHEN k % 7 = 0 THEN 'exact' WHEN k % 7 = 1 THEN 'prefix' END AS scope_mode,
       CASE WHEN k % 7 = 0 THEN 'src/core/a.rs' WHEN k % 7 = 1 THEN 'src/core' END AS scope_path
FROM {event_keys}
""")

# Two contexts per customer: before and after the coordinates moved.
adapter("contexts", """
SELECT CAST(c_custkey AS STRING) AS context_set, 'before' AS context_id,
       concat('r', CAST((c_custkey + CASE WHEN c_nationkey = 0 THEN 1 ELSE 0 END) % 5 AS STRING)) AS repository,
       concat('v', CAST(c_nationkey % 3 + 1 AS STRING)) AS revision,
       CASE WHEN c_nationkey % 2 = 0 THEN 'w1' END AS work,
       CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN 'src/corelib/a.rs' ELSE 'src/core/a.rs' END AS path
FROM {customer}
UNION ALL
SELECT CAST(c_custkey AS STRING) AS context_set, 'after' AS context_id,
       concat('r', CAST(c_custkey % 5 AS STRING)) AS repository,
       CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE concat('v', CAST((c_nationkey + 1) % 3 + 1 AS STRING)) END AS revision,
       'w1' AS work, 'src/core/a.rs' AS path
FROM {customer}
""")

adapter("dimension_rows", """
SELECT e.evidence_id, c.context_id, c.context_set, 'repository' AS dimension, e.repository AS required, c.repository AS actual,
       CASE WHEN c.repository IS NULL THEN 'missing' WHEN c.repository = e.repository THEN 'matched' ELSE 'mismatched' END AS status
FROM {evidence} e JOIN {contexts} c ON e.context_set = c.context_set WHERE e.repository IS NOT NULL
UNION ALL
SELECT e.evidence_id, c.context_id, c.context_set, 'revision' AS dimension, e.revision AS required, c.revision AS actual,
       CASE WHEN c.revision IS NULL THEN 'missing' WHEN c.revision = e.revision THEN 'matched' ELSE 'mismatched' END AS status
FROM {evidence} e JOIN {contexts} c ON e.context_set = c.context_set WHERE e.revision IS NOT NULL
UNION ALL
SELECT e.evidence_id, c.context_id, c.context_set, 'work' AS dimension, e.work AS required, c.work AS actual,
       CASE WHEN c.work IS NULL THEN 'missing' WHEN c.work = e.work THEN 'matched' ELSE 'mismatched' END AS status
FROM {evidence} e JOIN {contexts} c ON e.context_set = c.context_set WHERE e.work IS NOT NULL
UNION ALL
SELECT e.evidence_id, c.context_id, c.context_set, 'scope' AS dimension, concat(e.scope_mode, ':', e.scope_path) AS required, c.path AS actual,
       CASE WHEN c.path IS NULL THEN 'missing'
            WHEN c.path = e.scope_path OR (e.scope_mode = 'prefix' AND c.path LIKE concat(e.scope_path, '/%')) THEN 'matched'
            ELSE 'mismatched' END AS status
FROM {evidence} e JOIN {contexts} c ON e.context_set = c.context_set WHERE e.scope_path IS NOT NULL
""")

adapter("statuses", """
SELECT e.evidence_id, e.context_set, c.context_id,
       CASE WHEN d.n IS NULL THEN 'rejected' WHEN d.mismatched > 0 THEN 'invalid'
            WHEN d.missing > 0 THEN 'unknown' ELSE 'applies' END AS status
FROM {evidence} e JOIN {contexts} c ON e.context_set = c.context_set
LEFT JOIN (SELECT evidence_id, context_id, count(*) AS n,
                  sum(CASE WHEN status = 'mismatched' THEN 1 ELSE 0 END) AS mismatched,
                  sum(CASE WHEN status = 'missing' THEN 1 ELSE 0 END) AS missing
           FROM {dimension_rows} GROUP BY evidence_id, context_id) d
  ON d.evidence_id = e.evidence_id AND d.context_id = c.context_id
""")


@query("app_1_dimensions", "SELECT evidence_id, context_id, dimension, status, required, actual FROM {dimension_rows}")
def _(t):
    return app.evaluate_dimensions(t("evidence"), t("contexts"))


@query("app_2_applicability", "SELECT * FROM {statuses}")
def _(t):
    return app.applicability(t("evidence"), t("contexts"))


adapter("required_snapshots", """
SELECT CAST(event_id AS STRING) AS ref, CAST(user_id AS STRING) AS collection,
       CASE WHEN k % 9 = 0 THEN concat('sha1:', sha2_hex) ELSE concat('sha256:', sha2_hex) END AS required_id,
       CASE WHEN k % 3 = 0 THEN 'applies' WHEN k % 3 = 1 THEN 'invalid' END AS stored_status
FROM (SELECT event_id, user_id, k, concat(md5(CAST(user_id % 10 + k % 2 AS STRING)), md5('x')) AS sha2_hex FROM {event_keys}) h
""")
adapter("current_snapshots", """
SELECT CAST(c_custkey AS STRING) AS collection, concat('sha256:', md5(CAST(c_custkey % 10 AS STRING)), md5('x')) AS snapshot_id
FROM {customer} WHERE c_nationkey % 3 <> 0
""")


@query("app_3_snapshot_applicability", """
WITH s AS (
  SELECT r.*, c.snapshot_id AS actual_id,
         CASE WHEN NOT regexp_full_match(r.required_id, 'sha256:[0-9a-f]{64}') THEN 'rejected'
              WHEN c.snapshot_id IS NULL THEN 'unknown'
              WHEN c.snapshot_id = r.required_id THEN 'applies' ELSE 'invalid' END AS status
  FROM {required_snapshots} r LEFT JOIN {current_snapshots} c ON r.collection = c.collection)
SELECT ref, required_id, actual_id, status, coalesce(stored_status = status, true) AS stored_agrees FROM s
""")
def _(t):
    return app.snapshot_applicability(t("required_snapshots"), t("current_snapshots"))


adapter("edges", """
SELECT CAST(user_id AS STRING) AS context_set, CAST(event_id AS STRING) AS evidence_id, 'claim' AS target_kind,
       concat('c', CAST(event_id % 9 AS STRING)) AS target_id,
       CASE WHEN k % 10 < 6 THEN 'support' WHEN k % 10 = 6 THEN 'counterexample'
            WHEN k % 10 = 7 THEN 'limit' WHEN k % 10 = 8 AND event_id % 9 < 4 THEN 'dependency' ELSE 'support' END AS relation
FROM {event_keys} WHERE k % 12 <> 0
UNION ALL
SELECT CAST(user_id AS STRING) AS context_set, CAST(event_id AS STRING) AS evidence_id, 'obligation' AS target_kind,
       concat('o', CAST(event_id % 40 AS STRING)) AS target_id, 'clearing' AS relation
FROM {event_keys} WHERE k % 12 <> 0 AND k % 3 = 0
""")
adapter("claims", """
SELECT DISTINCT CAST(user_id AS STRING) AS context_set, concat('c', CAST(event_id % 12 AS STRING)) AS claim_id FROM {events}
""")
adapter("graph_obligations", """
SELECT DISTINCT CAST(user_id AS STRING) AS context_set, concat('o', CAST(event_id % 25 AS STRING)) AS obligation_id FROM {events}
""")


def _statuses(t):
    return app.applicability(t("evidence"), t("contexts"))


def _receipts(t):
    return just.relation_receipts(t("edges"), _statuses(t))


@query("just_1_relation_receipts", """
SELECT e.context_set, s.context_id, e.target_kind, e.target_id, e.relation, s.status, e.evidence_id
FROM {edges} e JOIN {statuses} s ON e.context_set = s.context_set AND e.evidence_id = s.evidence_id
""")
def _(t):
    return _receipts(t)


@query("just_1_receipt_counts", """
SELECT e.context_set, s.context_id, e.target_kind, e.target_id, e.relation,
       count(*) FILTER (WHERE s.status = 'applies') AS applies, count(*) FILTER (WHERE s.status = 'invalid') AS invalid,
       count(*) FILTER (WHERE s.status = 'unknown') AS unknown
FROM {edges} e JOIN {statuses} s ON e.context_set = s.context_set AND e.evidence_id = s.evidence_id
GROUP BY ALL
""")
def _(t):
    return just.receipt_counts(_receipts(t))


@query("just_2_claim_status", """
WITH r AS (SELECT e.*, s.context_id, s.status FROM {edges} e JOIN {statuses} s
           ON e.context_set = s.context_set AND e.evidence_id = s.evidence_id WHERE e.target_kind = 'claim'),
n AS (SELECT c.context_set, x.context_id, c.claim_id,
             count(*) FILTER (WHERE r.relation = 'support' AND r.status = 'applies') AS applying_support,
             count(*) FILTER (WHERE r.relation = 'dependency' AND r.status IN ('invalid', 'unknown')) AS blocking_dependencies,
             count(*) FILTER (WHERE r.relation = 'counterexample') AS counterexamples
      FROM {claims} c JOIN {contexts} x ON c.context_set = x.context_set
      LEFT JOIN r ON r.context_set = c.context_set AND r.context_id = x.context_id AND r.target_id = c.claim_id
      GROUP BY c.context_set, x.context_id, c.claim_id)
SELECT *, CASE WHEN applying_support > 0 AND blocking_dependencies = 0 THEN 'supported' ELSE 'unknown' END AS status FROM n
""")
def _(t):
    return just.claim_status(t("claims"), t("contexts"), _receipts(t))


@query("just_3_obligation_status", """
WITH r AS (SELECT e.*, s.context_id, s.status FROM {edges} e JOIN {statuses} s
           ON e.context_set = s.context_set AND e.evidence_id = s.evidence_id WHERE e.target_kind = 'obligation')
SELECT o.context_set, x.context_id, o.obligation_id,
       CASE WHEN count(*) FILTER (WHERE r.status = 'applies') > 0 THEN 'cleared'
            WHEN count(*) FILTER (WHERE r.status = 'unknown') > 0 THEN 'unknown' ELSE 'open' END AS status
FROM {graph_obligations} o JOIN {contexts} x ON o.context_set = x.context_set
LEFT JOIN r ON r.context_set = o.context_set AND r.context_id = x.context_id AND r.target_id = o.obligation_id
GROUP BY o.context_set, x.context_id, o.obligation_id
""")
def _(t):
    return just.obligation_status(t("graph_obligations"), t("contexts"), _receipts(t))


MOVED = """
SELECT b.context_set, b.evidence_id, b.status AS "before", a.status AS "after"
FROM (SELECT * FROM {statuses} WHERE context_id = 'before') b
JOIN (SELECT * FROM {statuses} WHERE context_id = 'after') a
  ON a.context_set = b.context_set AND a.evidence_id = b.evidence_id
WHERE a.status <> b.status
"""


def _moved(t):
    at = lambda c: app.applicability(t("evidence"), t("contexts").where(F.col("context_id") == c))
    return just.transitions(at("before"), at("after"))


@query("just_4_transitions", MOVED)
def _(t):
    return _moved(t)


@query("just_4_affected_targets", """
SELECT DISTINCT e.context_set, e.target_kind, e.target_id
FROM {edges} e JOIN (""" + MOVED + """) m ON e.context_set = m.context_set AND e.evidence_id = m.evidence_id
""")
def _(t):
    return just.affected_targets(t("edges"), _moved(t))


adapter("broken_edges", """
SELECT context_set, evidence_id, target_kind, target_id, relation FROM {edges}
UNION ALL
SELECT context_set, evidence_id, target_kind, target_id, relation FROM {edges} WHERE evidence_id LIKE '%77'
UNION ALL
SELECT context_set, concat('x', evidence_id) AS evidence_id, target_kind, target_id, relation FROM {edges} WHERE evidence_id LIKE '%55'
UNION ALL
SELECT context_set, evidence_id, target_kind, target_id, 'clearing' AS relation FROM {edges}
WHERE evidence_id LIKE '%33' AND target_kind = 'claim'
""")


@query("just_5_graph_violations", """
SELECT e.*, 'unknown_evidence' AS reason FROM {broken_edges} e
WHERE NOT EXISTS (SELECT 1 FROM {evidence} v WHERE v.context_set = e.context_set AND v.evidence_id = e.evidence_id)
UNION ALL
SELECT e.*, 'unknown_target' AS reason FROM {broken_edges} e
WHERE (e.target_kind = 'claim' AND NOT EXISTS (SELECT 1 FROM {claims} c WHERE c.context_set = e.context_set AND c.claim_id = e.target_id))
   OR (e.target_kind = 'obligation' AND NOT EXISTS (SELECT 1 FROM {graph_obligations} o WHERE o.context_set = e.context_set AND o.obligation_id = e.target_id))
UNION ALL
SELECT e.*, 'wrong_relation' AS reason FROM {broken_edges} e
WHERE (e.target_kind = 'claim' AND e.relation = 'clearing') OR (e.target_kind = 'obligation' AND e.relation <> 'clearing')
UNION ALL
SELECT context_set, evidence_id, target_kind, target_id, relation, 'duplicate_edge' AS reason FROM {broken_edges}
GROUP BY context_set, evidence_id, target_kind, target_id, relation HAVING count(*) > 1
UNION ALL
SELECT c.context_set, NULL, 'claim', c.claim_id, NULL, 'claim_without_support' FROM {claims} c
WHERE NOT EXISTS (SELECT 1 FROM {broken_edges} e WHERE e.context_set = c.context_set AND e.target_kind = 'claim'
                  AND e.relation = 'support' AND e.target_id = c.claim_id)
""")
def _(t):
    return just.graph_violations(t("evidence"), t("claims"), t("graph_obligations"), t("broken_edges"))


# One obligation per part; line items of the part act as clearing receipts.
adapter("obligations", """
SELECT CAST(p_partkey AS STRING) AS obligation_id, CAST(p_size AS STRING) AS context_set,
       concat('r', CAST(p_size % 5 AS STRING)) AS repository,
       CASE WHEN p_partkey % 3 = 0 THEN concat('v', CAST(p_partkey % 2 AS STRING)) END AS revision,
       CASE WHEN p_partkey % 5 = 0 THEN 'w1' END AS work,
       CASE WHEN p_partkey % 7 = 0 THEN 'prefix' END AS scope_mode,
       CASE WHEN p_partkey % 7 = 0 THEN 'src' END AS scope_path,
       'ci' AS missing_kind, lower(p_type) AS missing_target
FROM {part}
""")
adapter("obligation_contexts", """
SELECT CAST(p_size AS STRING) AS context_set, concat('r', CAST(p_size % 5 AS STRING)) AS repository,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'v0' END AS revision,
       CASE WHEN p_size % 3 = 0 THEN 'w2' WHEN p_size % 3 = 1 THEN 'w1' END AS work,
       CASE WHEN p_size % 2 = 0 THEN 'src/a.rs' END AS path
FROM (SELECT DISTINCT p_size FROM {part}) s
""")
adapter("conditions", """
SELECT obligation_id, missing_kind AS kind, missing_target AS target, repository, revision, work, scope_mode, scope_path FROM {obligations}
UNION ALL
SELECT obligation_id, missing_kind AS kind, missing_target AS target, repository, 'v0' AS revision, 'w1' AS work, scope_mode, scope_path FROM {obligations}
""")
adapter("clearing_receipts", """
SELECT o.obligation_id, concat(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING)) AS receipt_id,
       o.missing_kind AS kind, CASE WHEN l.l_linenumber = 7 OR l.l_quantity <= 47 THEN 'other' ELSE o.missing_target END AS target,
       o.repository, CASE WHEN l.l_linenumber % 2 = 0 THEN 'v0' ELSE o.revision END AS revision,
       CASE WHEN l.l_linenumber % 2 = 0 THEN 'w1' ELSE o.work END AS work, o.scope_mode, o.scope_path
FROM {lineitem} l JOIN {obligations} o ON CAST(l.l_partkey AS STRING) = o.obligation_id
""")

REQ = lambda a: f"""CASE
  WHEN {a}.repository <> x.repository OR {a}.revision <> x.revision OR {a}.work <> x.work
    OR (x.path <> {a}.scope_path AND NOT ({a}.scope_mode = 'prefix' AND x.path LIKE concat({a}.scope_path, '/%'))) THEN 'invalid'
  WHEN ({a}.repository IS NOT NULL AND x.repository IS NULL) OR ({a}.revision IS NOT NULL AND x.revision IS NULL)
    OR ({a}.work IS NOT NULL AND x.work IS NULL) OR ({a}.scope_path IS NOT NULL AND x.path IS NULL) THEN 'unknown'
  ELSE 'applies' END"""
SAME = """c.obligation_id = r.obligation_id AND c.kind = r.kind AND c.target = r.target
  AND c.repository IS NOT DISTINCT FROM r.repository AND c.revision IS NOT DISTINCT FROM r.revision
  AND c.work IS NOT DISTINCT FROM r.work AND c.scope_mode IS NOT DISTINCT FROM r.scope_mode
  AND c.scope_path IS NOT DISTINCT FROM r.scope_path"""


@query("obl_1_durable_obligations", f"""
WITH admitted AS (SELECT r.* FROM {{clearing_receipts}} r WHERE EXISTS (SELECT 1 FROM {{conditions}} c WHERE {SAME})),
s AS (SELECT o.*, {REQ('o')} AS subject FROM {{obligations}} o LEFT JOIN {{obligation_contexts}} x ON o.context_set = x.context_set),
n AS (SELECT s.obligation_id, s.subject, {REQ('r')} AS st, r.receipt_id
      FROM s LEFT JOIN {{obligation_contexts}} x ON s.context_set = x.context_set LEFT JOIN admitted r ON r.obligation_id = s.obligation_id),
g AS (SELECT obligation_id, subject AS subject_applicability,
             count(receipt_id) FILTER (WHERE st = 'applies') AS applies,
             count(receipt_id) FILTER (WHERE st = 'invalid') AS invalid,
             count(receipt_id) FILTER (WHERE st = 'unknown') AS unknown
      FROM n GROUP BY obligation_id, subject)
SELECT *, CASE WHEN subject_applicability = 'invalid' THEN 'reopen_required' WHEN subject_applicability = 'unknown' THEN 'unknown'
               WHEN applies > 0 THEN 'cleared' WHEN unknown > 0 THEN 'unknown' ELSE 'open' END AS status FROM g
""")
def _(t):
    return obl.durable_obligations(t("obligations"), t("conditions"), t("clearing_receipts"), t("obligation_contexts"))


@query("obl_2_unmatched_receipts", f"""
SELECT r.obligation_id, r.receipt_id FROM {{clearing_receipts}} r
WHERE NOT EXISTS (SELECT 1 FROM {{conditions}} c WHERE {SAME})
""")
def _(t):
    return obl.unmatched_receipts(t("clearing_receipts"), t("conditions"))
