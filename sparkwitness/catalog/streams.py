"""Streaming queries: the whole table arrives as a stream of several triggers and is drained."""

from pyspark.sql import functions as F

from ..operators import justification as just
from ..streaming import overlap, transitions
from ..streaming.sinks import drain, land_in_order, per_range, stateful_session
from .core import adapter, query

FILES = 2  # triggers that a table is cut into here; a real source has its own files

adapter("moving_contexts", """
SELECT CAST(user_id AS STRING) AS context_set, CAST(ts AS TIMESTAMP) AS observed_at, event_id AS sequence,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('r', CAST(event_id % 2 AS STRING)) END AS repository,
       concat('v', CAST(event_id % 3 AS STRING)) AS revision, CAST(NULL AS STRING) AS work, CAST(NULL AS STRING) AS path
FROM {events}
""")
adapter("standing_evidence", """
SELECT concat('e', CAST(c_custkey AS STRING)) AS evidence_id, CAST(c_custkey AS STRING) AS context_set,
       CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'r1' END AS repository, CASE WHEN c_nationkey % 3 = 1 THEN NULL ELSE 'v1' END AS revision,
       CAST(NULL AS STRING) AS work, CAST(NULL AS STRING) AS scope_mode, CAST(NULL AS STRING) AS scope_path
FROM {customer}
""")
adapter("standing_edges", """
SELECT context_set, evidence_id, 'claim' AS target_kind, concat('c', context_set) AS target_id, 'support' AS relation FROM {standing_evidence}
""")
# Decided are rows that the last watermark has passed, in whole milliseconds: an hour before the newest context of all.
TRANSITIONS = """
SELECT context_set, evidence_id, observed_at, sequence, "before", status AS "after" FROM (
  SELECT *, lag(status) OVER (PARTITION BY context_set, evidence_id ORDER BY observed_at, sequence) AS "before",
         lag(observed_at) OVER (PARTITION BY context_set, evidence_id ORDER BY observed_at, sequence) AS before_at FROM (
    SELECT c.context_set, e.evidence_id, c.observed_at, c.sequence,
           CASE WHEN c.repository <> e.repository OR c.revision <> e.revision THEN 'invalid' WHEN e.repository IS NOT NULL AND c.repository IS NULL THEN 'unknown' ELSE 'applies' END AS status
    FROM {moving_contexts} c JOIN {standing_evidence} e ON e.context_set = c.context_set) s) w
WHERE "before" IS NOT NULL AND "before" <> status AND observed_at <= before_at + INTERVAL 30 DAY
  AND observed_at <= (SELECT date_trunc('millisecond', max(observed_at)) - INTERVAL 1 HOUR FROM {moving_contexts})
"""


def _transitions(t):
    landed = land_in_order(t("events"), "ts", FILES)
    stream = t.arriving(stateful_session(t.spark), events=(landed, per_range(t.spark, landed, FILES)))
    rows = transitions.status_transitions(stream("moving_contexts"), stream("standing_evidence"))
    return drain(rows, "transitions", into=t.spark)


@query("str_1_status_transitions", f"""
SELECT context_set, evidence_id, strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') AS observed_at, "before", "after" FROM ({TRANSITIONS}) x
""")
def _(t):
    return _transitions(t).withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("str_1_affected_targets", f"""
SELECT DISTINCT e.context_set, e.target_kind, e.target_id FROM {{standing_edges}} e JOIN ({TRANSITIONS}) x ON x.context_set = e.context_set AND x.evidence_id = e.evidence_id
""")
def _(t):
    return just.affected_targets(t("standing_edges"), _transitions(t))


adapter("arriving_paths", """
SELECT CAST(l_orderkey - l_orderkey % 50 AS STRING) AS snapshot_id, concat('#', CAST(l_orderkey AS STRING)) AS id, l_orderkey % 50 = 7 AS is_current, path,
       CAST(l_shipdate AS TIMESTAMP) AS seen_at
FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
""")


@query("str_2_overlap_stream", """
SELECT DISTINCT a.snapshot_id, a.id AS current_id, b.id AS other_id, a.path FROM {arriving_paths} a
JOIN {arriving_paths} b ON b.snapshot_id = a.snapshot_id AND b.path = a.path AND NOT b.is_current
  AND b.seen_at BETWEEN a.seen_at - INTERVAL 300 DAY AND a.seen_at + INTERVAL 300 DAY
WHERE a.is_current
""")
def _(t):
    # Null dates come first: they meet nothing and hold no watermark back.
    landed = land_in_order(t("lineitem"), "l_shipdate", FILES)
    stream = t.arriving(stateful_session(t.spark), lineitem=(landed, per_range(t.spark, landed, FILES)))
    return drain(overlap.overlap_stream(stream("arriving_paths"), window="300 days"), "overlap", into=t.spark)
