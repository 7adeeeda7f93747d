"""Text scan and order policies."""

from pyspark.sql import functions as F

from ..operators import policy as pol
from ..operators import scan as sc
from .core import adapter, query

# Whole documents with reference lines, fences, inline code and markers around the text.
adapter("scanned_texts", """
SELECT CAST(doc_id AS STRING) AS source, concat('Home/r', CAST(doc_id % 5 AS STRING)) AS repository,
       concat('see https://github.com/Other/', lang, '/issues/', CAST(doc_id AS STRING), '. and https://github.com/home/r', CAST(doc_id % 7 AS STRING), '/x', chr(13), chr(10),
              CASE WHEN doc_id % 3 = 0 THEN concat('  ```', chr(10), 'https://github.com/a/b other/name#1', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('~~~', chr(10)) ELSE '' END) ELSE '' END,
              'Ref other/', lang, '#', CAST(doc_id AS STRING), ', mine/repo#2 and `code/x#3` x.y/z#4b', chr(10),
              CASE WHEN doc_id % 4 = 0 THEN concat(' <!-- allow-external-reference --> ', chr(10)) ELSE '' END,
              'https://github.com/third/party?x=1', CASE WHEN doc_id % 5 = 0 THEN ' <!-- allow-external-reference -->' ELSE '' END, chr(10),
              text, chr(10), 'https://github.com/only and (https://github.com/last/one)') AS text
FROM {documents}
""")
adapter("owned_owners", "SELECT lower(r_name) AS owner FROM {region} UNION ALL SELECT 'mine' AS owner FROM {region} WHERE r_regionkey = 0")
SCAN = """
WITH l AS (SELECT source, repository, line, s FROM (
       SELECT source, repository, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line, unnest(string_split(t, chr(10))) AS s
       FROM (SELECT source, repository, replace(text, concat(chr(13), chr(10)), chr(10)) AS t FROM {scanned_texts}) a) b),
f AS (SELECT *, regexp_matches(s, '^\\s*(```|~~~)') AS fence,
             sum(CASE WHEN regexp_matches(s, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line) AS fences,
             lag(s) OVER (PARTITION BY source ORDER BY line) AS before FROM l),
c AS (SELECT *, regexp_replace(s, '`[^`]*`', '', 'g') AS z FROM f
      WHERE NOT fence AND fences % 2 = 0 AND NOT contains(s, '<!-- allow-external-reference -->') AND coalesce(trim(before), '') <> '<!-- allow-external-reference -->'),
u AS (SELECT source, repository, line, regexp_replace(unnest(regexp_extract_all(z, 'https?://github\\.com/[^\\s<>()\\[\\]`"'']+')), '[.,;:!?]+$', '') AS url, true AS direct FROM c
      UNION ALL
      SELECT source, repository, line, unnest(regexp_extract_all(z, '(?:^|[^A-Za-z0-9_.-])([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#[0-9]+)\\b', 1)), false FROM c),
n AS (SELECT *, lower(CASE WHEN direct THEN regexp_extract(url, '^https?://github\\.com/([^/?#]+/[^/?#]+)', 1) ELSE split_part(url, '#', 1) END) AS named FROM u)
SELECT source, line, url FROM n
WHERE named <> '' AND named <> lower(repository) AND split_part(named, '/', 1) NOT IN (SELECT owner FROM {owned_owners})
"""


@query("scan_1_references", SCAN)
def _(t):
    return sc.scan_references(t("scanned_texts"), t("owned_owners"))


adapter("policy_events", """
SELECT CAST(user_id AS STRING) AS session, event_id AS seq,
       CASE WHEN k % 4 = 0 THEN 'release' WHEN k % 9 = 1 THEN 'call' ELSE 'acquire' END AS action,
       concat('g', CAST(k % 5 AS STRING)) AS guard, CASE WHEN k % 9 = 1 AND k % 4 <> 0 THEN concat('helper', CAST(k % 2 AS STRING)) ELSE event_type END AS resource
FROM {event_keys}
""")
adapter("plain_events", "SELECT * FROM {policy_events} WHERE action <> 'call'")
adapter("rank_rules", """
SELECT resource, rank
FROM (SELECT DISTINCT event_type AS resource,
             CASE event_type WHEN 'click' THEN 'low' WHEN 'view' THEN 'mid' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'low' ELSE 'top' END AS one,
             CASE WHEN event_type = 'signup' THEN 'mid' END AS other FROM {events}) r
UNPIVOT (rank FOR side IN (one, other))
""")
adapter("rank_followers", """
SELECT DISTINCT CASE WHEN event_id % 5 < 3 THEN 'low' ELSE 'mid' END AS rank,
       CASE event_id % 5 WHEN 0 THEN 'mid' WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 3 THEN 'high' ELSE 'top' END AS follower
FROM {events}
""")
adapter("rank_levels", """
SELECT DISTINCT event_type AS resource, CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 WHEN 'purchase' THEN 20 ELSE 30 END AS level FROM {events} WHERE event_type <> 'signup'
""")
UNIQUE = "SELECT resource, min(rank) AS rank FROM {rank_rules} GROUP BY resource HAVING count(*) = 1"


def _successor(events: str) -> str:
    return f"""
WITH k AS ({UNIQUE}), e AS (SELECT * FROM {events}),
a AS (SELECT e.*, k.rank FROM e JOIN k ON k.resource = e.resource WHERE e.action = 'acquire'),
open AS (SELECT t.session, t.seq, t.resource AS acquired, t.rank AS acquired_rank, p.resource AS held, p.rank AS held_rank,
                t.position, row_number() OVER (PARTITION BY t.session, t.seq, t.position, t.resource ORDER BY p.seq DESC, p.position DESC) AS rn
         FROM a t JOIN a p ON p.session = t.session AND (p.seq < t.seq OR (p.seq = t.seq AND p.position < t.position))
         WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.action = 'release' AND r.session = p.session AND r.guard = p.guard AND r.seq > p.seq AND r.seq < t.seq))
SELECT session, seq, position, held, acquired, held_rank, acquired_rank FROM open
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {{rank_followers}} f WHERE f.rank = held_rank AND f.follower = acquired_rank)
"""


@query("pol_1_successor_violations", _successor("(SELECT *, CAST(0 AS BIGINT) AS position FROM {plain_events}) z"))
def _(t):
    return pol.successor_violations(t("plain_events"), t("rank_rules"), t("rank_followers"))


@query("pol_2_rank_violations", """
SELECT session, seq, resource, level, highest FROM (
  SELECT e.session, e.seq, e.resource, l.level, max(l.level) OVER (PARTITION BY e.session ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest
  FROM {plain_events} e JOIN {rank_levels} l ON l.resource = e.resource WHERE e.action = 'acquire') x WHERE level < highest
""")
def _(t):
    return pol.rank_violations(t("plain_events"), t("rank_levels"))


adapter("policy_pairs", """
SELECT DISTINCT a.event_type AS held, b.resource AS acquired FROM {events} a JOIN {policy_events} b ON a.event_id = b.seq + 1
""")


@query("pol_3_policy_decisions", f"""
WITH k AS ({UNIQUE})
SELECT p.held, p.acquired,
       CASE WHEN h.rank IS NULL OR a.rank IS NULL THEN 'unknown' WHEN EXISTS (SELECT 1 FROM {{rank_followers}} f WHERE f.rank = h.rank AND f.follower = a.rank) THEN 'allow' ELSE 'deny' END AS successor_decision,
       CASE WHEN hl.level IS NULL OR al.level IS NULL THEN 'unknown' WHEN al.level >= hl.level THEN 'allow' ELSE 'deny' END AS numeric_decision
FROM {{policy_pairs}} p LEFT JOIN k h ON h.resource = p.held LEFT JOIN k a ON a.resource = p.acquired
LEFT JOIN {{rank_levels}} hl ON hl.resource = p.held LEFT JOIN {{rank_levels}} al ON al.resource = p.acquired
""")
def _(t):
    return pol.policy_decisions(t("policy_pairs"), t("rank_rules"), t("rank_followers"), t("rank_levels"))


adapter("helper_effects", """
SELECT concat('helper', CAST(r.r_regionkey % 2 AS STRING)) AS helper, r.r_regionkey * 2 + CASE WHEN t.resource = 'error' THEN 1 ELSE 0 END AS position, t.resource
FROM {region} r JOIN (SELECT DISTINCT event_type AS resource, length(event_type) AS n FROM {events}) t ON t.n = r.r_regionkey + 4
""")
EXPANDED = """
SELECT session, seq, CAST(0 AS BIGINT) AS position, action, guard, resource, 'direct' AS origin FROM {policy_events} WHERE action <> 'call'
UNION ALL SELECT e.session, e.seq, h.position, 'acquire', e.guard, h.resource, 'helper' FROM {policy_events} e JOIN {helper_effects} h ON h.helper = e.resource WHERE e.action = 'call'
"""


@query("pol_4_expand_effects", EXPANDED)
def _(t):
    return pol.expand_effects(t("policy_events"), t("helper_effects"))


@query("pol_4_effect_violations", _successor(f"({EXPANDED}) w"))
def _(t):
    events = pol.expand_effects(t("policy_events"), t("helper_effects")).drop("origin")
    return pol.successor_violations(events, t("rank_rules"), t("rank_followers"))
