"""Budgeted packets."""

from pyspark.sql import functions as F

from ..operators import history as hist
from ..operators import packets as op
from .core import adapter, query
from .history import COMPANIONS

adapter("packet_items", """
SELECT CAST(user_id AS STRING) AS target,
       CASE k % 8 WHEN 0 THEN 'core' WHEN 1 THEN 'companion_exclusion_detail' WHEN 2 THEN 'recent_history_summary' WHEN 3 THEN 'historical_companion_relation'
                  WHEN 4 THEN 'historical_counterexample' WHEN 5 THEN 'historical_support_example' ELSE 'scope_recent_history_summary' END AS class,
       event_id AS rank, k + 40 AS bytes, CASE WHEN k % 8 > 5 THEN concat('s', CAST(event_id AS STRING)) END AS sha
FROM {event_keys}
""")
adapter("packet_budgets", """
SELECT CAST(c_custkey AS STRING) AS target, CAST(c_nationkey * 300 + 100 AS BIGINT) AS budget FROM {customer}
""")
PRIORITY = """CASE class WHEN 'core' THEN 0 WHEN 'companion_exclusion_detail' THEN 1 WHEN 'recent_history_summary' THEN 2 WHEN 'historical_companion_relation' THEN 3
  WHEN 'historical_counterexample' THEN 4 WHEN 'historical_support_example' THEN 5 ELSE 6 END"""


def _packed(source: str, priority: str) -> str:
    return f"""SELECT *, CASE WHEN core > budget THEN NULL ELSE priority = 0 OR core + used <= budget END AS kept FROM (
      SELECT i.*, b.budget, coalesce(sum(CASE WHEN priority = 0 THEN bytes END) OVER (PARTITION BY i.target), 0) AS core,
             coalesce(sum(CASE WHEN priority > 0 THEN bytes END) OVER (PARTITION BY i.target ORDER BY priority, rank), 0) AS used
      FROM (SELECT *, {priority} AS priority FROM {source}) i JOIN {{packet_budgets}} b ON b.target = i.target) p"""


PACKED = _packed("{packet_items}", PRIORITY)


def _pack(t):
    return op.pack_evidence(t("packet_items").drop("sha"), t("packet_budgets"))


@query("pkt_1_pack_evidence", f"SELECT target, class, rank, bytes, kept FROM ({PACKED}) q")
def _(t):
    return _pack(t)


@query("pkt_1_packet_summary", f"""
SELECT target, budget, CAST(sum(bytes) AS BIGINT) AS candidate_bytes, CAST(max(core) AS BIGINT) AS core_bytes, CAST(sum(CASE WHEN kept THEN bytes END) AS BIGINT) AS kept_bytes,
       CASE WHEN max(core) > budget THEN 'protected_core_too_large' ELSE 'packed' END AS status
FROM ({PACKED}) q GROUP BY target, budget
""")
def _(t):
    return op.packet_summary(_pack(t), t("packet_budgets"))


@query("pkt_1_eviction_counts", f"""
SELECT target, class, count(*) AS evicted, CAST(sum(bytes) AS BIGINT) AS evicted_bytes FROM ({PACKED}) q WHERE NOT kept GROUP BY target, class
""")
def _(t):
    return op.eviction_counts(_pack(t))


@query("pkt_2_cap_companions", f"""
WITH base AS ({COMPANIONS}), r AS (SELECT *, row_number() OVER (PARTITION BY repository, anchor ORDER BY support DESC, path) AS rank,
       count(*) OVER (PARTITION BY repository, anchor) AS n FROM base)
SELECT repository, anchor, path, rank, support, opportunities, support_percent, greatest(support - 2, 0) AS examples_omitted,
       greatest(opportunities - support - 2, 0) AS counterexamples_omitted, greatest(n - 8, 0) AS omitted_companions,
       least(support, 2) AS example_count, least(opportunities - support, 2) AS counterexample_count
FROM r WHERE rank <= 8
""")
def _(t):
    cohort = hist.anchor_cohort(t("commits"), t("commit_paths"), max_commits=100, max_paths=6)
    capped = op.cap_companions(hist.companions(cohort, t("commit_paths")))
    return capped.select(
        *[c for c in capped.columns if c not in ("examples", "counterexamples")],
        F.size("examples").cast("long").alias("example_count"), F.size("counterexamples").cast("long").alias("counterexample_count"),
    )


adapter("protected_rows", """
SELECT target, sha FROM {packet_items} WHERE sha IS NOT NULL AND rank % 5 = 0
UNION ALL SELECT target, concat('missing', target) AS sha FROM {packet_budgets}
""")


@query("pkt_3_pack_scoped", f"""
WITH marked AS (SELECT i.*, i.class = 'scope_recent_history_summary' AND EXISTS (SELECT 1 FROM {{protected_rows}} p WHERE p.target = i.target AND p.sha = i.sha) AS protected FROM {{packet_items}} i)
SELECT target, class, rank, bytes, protected, kept FROM ({_packed("marked", f"CASE WHEN protected THEN 0 ELSE {PRIORITY} END")}) q
""")
def _(t):
    return op.pack_scoped(t("packet_items"), t("protected_rows"), t("packet_budgets"))


@query("pkt_3_absent_protected", """
SELECT DISTINCT p.target, p.sha FROM {protected_rows} p
WHERE NOT EXISTS (SELECT 1 FROM {packet_items} i WHERE i.target = p.target AND i.sha = p.sha AND i.class = 'scope_recent_history_summary')
""")
def _(t):
    return op.absent_protected(t("packet_items"), t("protected_rows"))
