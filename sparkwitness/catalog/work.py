"""Concurrent work, coordination, branches."""

from pyspark.sql import functions as F

from ..operators import branches as br
from ..operators import coordination as co
from ..operators import work as wk
from .core import adapter, query

adapter("sets_a", "SELECT concat('#', CAST(l_orderkey AS STRING)) AS a, path FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey")
adapter("sets_b", "SELECT concat('#', CAST(l_orderkey AS STRING)) AS b, path FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey")
adapter("set_pairs", """
SELECT o_orderkey AS pair_id, concat('#', CAST(o_orderkey AS STRING)) AS a, concat('#', CAST(o_orderkey + 1 AS STRING)) AS b FROM {orders}
""")


@query("work_1_change_overlap", """
WITH pa AS (SELECT DISTINCT * FROM {sets_a} WHERE path = 'promo' OR path LIKE 'promo/%'),
pb AS (SELECT DISTINCT * FROM {sets_b} WHERE path = 'promo' OR path LIKE 'promo/%')
SELECT p.pair_id, p.a, p.b, coalesce(na.n, 0) AS size_a, coalesce(nb.n, 0) AS size_b, s.path
FROM {set_pairs} p
LEFT JOIN (SELECT a, count(*) AS n FROM pa GROUP BY a) na ON na.a = p.a
LEFT JOIN (SELECT b, count(*) AS n FROM pb GROUP BY b) nb ON nb.b = p.b
LEFT JOIN (SELECT q.pair_id, pa.path FROM {set_pairs} q JOIN pa ON pa.a = q.a JOIN pb ON pb.b = q.b AND pb.path = pa.path) s
  ON s.pair_id = p.pair_id
""")
def _(t):
    return wk.change_overlap(t("sets_a"), t("sets_b"), t("set_pairs"), scope="promo")


adapter("overlap_rows", """
SELECT a.snapshot_id, a.id AS current_id, b.id AS other_id, a.path, w.activity,
       CASE WHEN w.activity = 'unresolved' THEN 'path_overlap_activity_unknown' ELSE 'path_overlap' END AS finding_kind
FROM {currents} c JOIN {work_paths} a ON a.snapshot_id = c.snapshot_id AND a.id = c.id
JOIN {work_paths} b ON b.snapshot_id = a.snapshot_id AND b.path = a.path AND b.id <> a.id
JOIN {work_items} w ON w.snapshot_id = b.snapshot_id AND w.id = b.id
""")


@query("work_2_inventory_overlap", "SELECT * FROM {overlap_rows}")
def _(t):
    return wk.inventory_overlap(t("work_items"), t("work_paths"), t("currents"))


@query("work_2_inventory_counts", """
SELECT c.snapshot_id, c.id AS current_id, count(*) FILTER (WHERE w.id <> c.id) AS candidates_examined,
       count(*) FILTER (WHERE w.id = c.id) AS self_candidates_excluded,
       coalesce(max(o.n), 0) AS direct_overlaps
FROM {currents} c JOIN {work_items} w ON w.snapshot_id = c.snapshot_id
LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM {overlap_rows} GROUP BY snapshot_id) o ON o.snapshot_id = c.snapshot_id
GROUP BY c.snapshot_id, c.id
""")
def _(t):
    overlaps = wk.inventory_overlap(t("work_items"), t("work_paths"), t("currents"))
    return wk.inventory_counts(t("work_items"), t("currents"), overlaps)


adapter("focus_paths", """
SELECT DISTINCT CAST(p_size AS STRING) AS snapshot_id, path FROM {part} p JOIN {part_path} q ON p.p_partkey = q.p_partkey
WHERE p.p_retailprice < 950
""")


@query("work_3_heads_up", """
WITH changed AS (SELECT w.snapshot_id, w.path FROM {work_paths} w JOIN {currents} c ON w.snapshot_id = c.snapshot_id AND w.id = c.id),
eff AS (SELECT snapshot_id, path, max(ch) AS ch, max(fo) AS fo FROM (
          SELECT snapshot_id, path, 1 AS ch, 0 AS fo FROM changed UNION ALL SELECT snapshot_id, path, 0, 1 FROM {focus_paths}) u
        GROUP BY snapshot_id, path),
me AS (SELECT c.snapshot_id, c.id, w.head_sha FROM {currents} c JOIN {work_items} w ON w.snapshot_id = c.snapshot_id AND w.id = c.id),
f AS (SELECT p.snapshot_id, me.id AS current_id, p.id AS other_id, count(*) AS overlap_size,
             string_agg(p.path, ',' ORDER BY p.path) AS overlap_paths,
             coalesce(string_agg(p.path, ',' ORDER BY p.path) FILTER (WHERE e.ch = 1), '') AS changed_overlap_paths,
             coalesce(string_agg(p.path, ',' ORDER BY p.path) FILTER (WHERE e.fo = 1), '') AS focus_overlap_paths
      FROM {work_paths} p JOIN eff e ON e.snapshot_id = p.snapshot_id AND e.path = p.path
      JOIN {work_items} w ON w.snapshot_id = p.snapshot_id AND w.id = p.id
      JOIN me ON me.snapshot_id = p.snapshot_id
      WHERE p.id <> me.id AND w.head_sha <> me.head_sha GROUP BY p.snapshot_id, me.id, p.id),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY overlap_size DESC, other_id) AS rank,
             greatest(count(*) OVER (PARTITION BY snapshot_id) - 12, 0) AS omitted FROM f)
SELECT * FROM r WHERE rank <= 12
""")
def _(t):
    rows = wk.heads_up(t("work_items"), t("work_paths"), t("focus_paths"), t("currents"))
    lists = ["overlap_paths", "changed_overlap_paths", "focus_overlap_paths"]
    return rows.withColumns({c: F.array_join(c, ",") for c in lists})


@query("work_4_has_overlap", """
SELECT c.snapshot_id, c.id AS current_id, EXISTS (SELECT 1 FROM {overlap_rows} o WHERE o.snapshot_id = c.snapshot_id) AS overlaps
FROM {currents} c
""")
def _(t):
    return wk.has_overlap(t("work_paths"), t("currents"))


# Edges between an item and the next order of the same customer group, and to the current item.
adapter("coordination_edges", """
SELECT w.snapshot_id, CASE CAST(substring(w.id, 2) AS BIGINT) % 4 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'blocks'
         WHEN 2 THEN 'hold_merge_while' ELSE 'supersedes' END AS kind,
       CASE WHEN w.activity = 'preparation' THEN c.id ELSE w.id END AS from_id,
       CASE WHEN w.activity = 'preparation' THEN w.id ELSE c.id END AS to_id, concat('issue:', w.head_sha) AS source
FROM {work_items} w JOIN {currents} c ON c.snapshot_id = w.snapshot_id
WHERE w.id <> c.id AND CAST(substring(w.id, 2) AS BIGINT) % 9 < 2
""")


@query("coord_1_findings", """
WITH ov AS (SELECT DISTINCT a.snapshot_id, b.id FROM {currents} c JOIN {work_paths} a ON a.snapshot_id = c.snapshot_id AND a.id = c.id
            JOIN {work_paths} b ON b.snapshot_id = a.snapshot_id AND b.path = a.path
            WHERE a.path LIKE 'promo/%' OR a.path = 'promo')
SELECT e.snapshot_id, c.id AS current_id, e.kind, e.from_id, e.to_id, e.source, w.id AS other_id,
       ov.id IS NULL AS no_scoped_overlap, w.activity = 'unresolved' AS activity_unresolved,
       CASE e.kind WHEN 'depends_on' THEN 'Can this change go ahead before what it depends on is settled?' WHEN 'blocks' THEN 'Which of the two waits, and who owns the overlap meanwhile?'
         WHEN 'hold_merge_while' THEN 'In which order do the two merge?' ELSE 'Is the replaced change closed, or does something of it remain to be taken over?' END AS question
FROM {coordination_edges} e JOIN {currents} c ON c.snapshot_id = e.snapshot_id AND c.id IN (e.from_id, e.to_id)
JOIN {work_items} w ON w.snapshot_id = e.snapshot_id AND w.id = CASE WHEN e.from_id = c.id THEN e.to_id ELSE e.from_id END
LEFT JOIN ov ON ov.snapshot_id = w.snapshot_id AND ov.id = w.id
""")
def _(t):
    return co.coordination_findings(t("coordination_edges"), t("work_items"), t("work_paths"), t("currents"), scope="promo")


# A body with clauses inside and outside fences; every line is built from the key.
adapter("work_metadata", """
SELECT CAST(o_custkey % 50 AS STRING) AS snapshot_id, concat('#', CAST(o_orderkey AS STRING)) AS id,
       concat('github:pull/', CAST(o_orderkey AS STRING)) AS source,
       concat('Intro', chr(10),
         CASE WHEN o_orderkey % 3 = 0 THEN concat('Do not merge while #', CAST(o_orderkey + 50 * (o_custkey % 2) AS STRING), ' is open.', chr(13), chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 5 = 0 THEN concat('  ````text', chr(10), 'Do not merge while #1 is open', chr(10), '```', chr(10),
                                                  CASE WHEN o_orderkey % 2 = 0 THEN concat(' ````  ', chr(10)) ELSE '' END) ELSE '' END,
         CASE WHEN o_orderkey % 4 = 0 THEN concat('Do not merge while #', CAST(o_orderkey + 1 AS STRING), ' lands', chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 8 = 0 THEN concat('Do not merge while #', CAST(o_orderkey + 1 AS STRING), ' lands', chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 7 = 0 THEN concat('Do not merge while #0', CAST(o_orderkey AS STRING), ' lands', chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 6 = 0 THEN concat('Do not merge while #', CAST(o_orderkey + 2 AS STRING), ' ', chr(10)) ELSE '' END,
         'End') AS body
FROM {numbered_orders}
""")
# What the construction above implies, written without reading the text.
adapter("clauses", """
SELECT m.snapshot_id, concat('#', CAST(m.o AS STRING)) AS from_id, concat('#', CAST(m.target AS STRING)) AS to_id,
       concat('github:pull/', CAST(m.o AS STRING)) AS source,
       CASE WHEN m.target = m.o THEN 'self' WHEN k.o_orderkey IS NULL THEN 'unresolved' ELSE 'edge' END AS endpoint
FROM (
  SELECT CAST(o_custkey % 50 AS STRING) AS snapshot_id, o_custkey % 50 AS snap, o_orderkey AS o, o_orderkey + 50 * (o_custkey % 2) AS target
  FROM {numbered_orders} WHERE o_orderkey % 3 = 0
  UNION ALL
  SELECT CAST(o_custkey % 50 AS STRING), o_custkey % 50, o_orderkey, o_orderkey + 1
  FROM {numbered_orders} WHERE o_orderkey % 4 = 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0)
  UNION ALL
  SELECT CAST(o_custkey % 50 AS STRING), o_custkey % 50, o_orderkey, o_orderkey + 1
  FROM {numbered_orders} WHERE o_orderkey % 8 = 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0)
) m LEFT JOIN {numbered_orders} k ON k.o_orderkey = m.target AND k.o_custkey % 50 = m.snap
""")


@query("coord_2_hold_clauses", "SELECT * FROM {clauses}")
def _(t):
    return co.hold_clauses(t("work_metadata"))


@query("coord_2_hold_edges", """
SELECT DISTINCT snapshot_id, 'hold_merge_while' AS kind, from_id, to_id, source FROM {clauses} WHERE endpoint = 'edge'
""")
def _(t):
    return co.hold_edges(co.hold_clauses(t("work_metadata")))


@query("coord_2_hold_stats", """
SELECT w.snapshot_id, w.n AS work_items_examined, coalesce(c.n, 0) AS operative_clauses_matched,
       coalesce(c.s, 0) AS self_references_ignored, coalesce(c.u, 0) AS unresolved_endpoints_ignored,
       coalesce(c.e - c.d, 0) AS duplicate_edges_ignored
FROM (SELECT snapshot_id, count(*) AS n FROM {work_metadata} GROUP BY snapshot_id) w
LEFT JOIN (SELECT snapshot_id, count(*) AS n, count(*) FILTER (WHERE endpoint = 'self') AS s,
                  count(*) FILTER (WHERE endpoint = 'unresolved') AS u, count(*) FILTER (WHERE endpoint = 'edge') AS e,
                  count(DISTINCT concat(from_id, to_id)) FILTER (WHERE endpoint = 'edge') AS d
           FROM {clauses} GROUP BY snapshot_id) c ON c.snapshot_id = w.snapshot_id
""")
def _(t):
    return co.hold_stats(t("work_metadata"), co.hold_clauses(t("work_metadata")))


adapter("metadata_currents", "SELECT snapshot_id, min(from_id) AS id FROM {clauses} WHERE endpoint = 'unresolved' GROUP BY snapshot_id")


@query("coord_3_unresolved_for_current", """
SELECT c.snapshot_id, c.id AS current_id, count(u.from_id) AS unresolved_endpoints
FROM {metadata_currents} c LEFT JOIN (SELECT DISTINCT snapshot_id, from_id, to_id FROM {clauses} WHERE endpoint = 'unresolved') u
  ON u.snapshot_id = c.snapshot_id AND c.id IN (u.from_id, u.to_id)
GROUP BY c.snapshot_id, c.id
""")
def _(t):
    unresolved = co.unresolved_endpoints(co.hold_clauses(t("work_metadata")))
    return co.unresolved_for_current(unresolved, t("metadata_currents"))


adapter("branch_refs", """
SELECT concat('r', CAST(o_custkey % 40 AS STRING)) AS repository, concat('b', CAST(o_orderkey AS STRING)) AS branch,
       CAST(o_orderkey % 1000 AS STRING) AS sha, o_orderdate AS committed_at FROM {orders}
""")
adapter("open_heads", """
SELECT concat('r', CAST(o_custkey % 40 AS STRING)) AS repository, concat('b', CAST(o_orderkey AS STRING)) AS branch
FROM {orders} WHERE o_orderkey % 5 = 0
""")
adapter("provider_refs", """
SELECT concat('r', CAST(o_custkey % 40 AS STRING)) AS repository, concat('b', CAST(o_orderkey AS STRING)) AS branch,
       CAST((o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 1000 AS STRING) AS provider_sha,
       CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_orderkey % 6 = 2 END AS truncated
FROM {orders} WHERE o_orderkey % 9 <> 0
""")
adapter("associated", """
SELECT concat('r', CAST(o_custkey % 40 AS STRING)) AS repository, CAST(o_orderkey % 1000 AS STRING) AS provider_sha,
       concat('b', CAST(o_orderkey AS STRING)) AS branch,
       CASE l_returnflag WHEN 'A' THEN 'OPEN' WHEN 'N' THEN 'MERGED' ELSE 'CLOSED' END AS state
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
""")
DECISIONS = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY committed_at DESC, branch DESC) AS rn
           FROM {branch_refs} r WHERE NOT EXISTS (SELECT 1 FROM {open_heads} h WHERE h.repository = r.repository AND h.branch = r.branch))
SELECT c.repository, c.branch, c.sha,
       CASE WHEN p.provider_sha IS NULL THEN 'provider_ref_missing' WHEN p.provider_sha <> c.sha THEN 'provider_head_mismatch'
            WHEN p.truncated IS NULL THEN 'association_truncated_unknown'
            WHEN EXISTS (SELECT 1 FROM {associated} a WHERE a.repository = c.repository AND a.provider_sha = c.sha AND a.branch = c.branch AND a.state = 'OPEN') THEN 'provider_open_pr_race'
            WHEN EXISTS (SELECT 1 FROM {associated} a WHERE a.repository = c.repository AND a.provider_sha = c.sha AND a.branch = c.branch AND a.state <> 'OPEN') THEN 'retired_exact_branch_head'
            WHEN p.truncated THEN 'association_truncated_unknown' ELSE 'admitted' END AS decision
FROM c LEFT JOIN {provider_refs} p ON p.repository = c.repository AND p.branch = c.branch WHERE c.rn <= 20
"""


@query("branch_1_admission", DECISIONS)
def _(t):
    return br.admit_branches(t("branch_refs"), t("open_heads"), t("provider_refs"), t("associated"))


@query("branch_1_receipts", "SELECT repository, decision, count(*) AS branches FROM (" + DECISIONS + ") d GROUP BY repository, decision")
def _(t):
    return br.branch_receipts(br.admit_branches(t("branch_refs"), t("open_heads"), t("provider_refs"), t("associated")))


@query("branch_1_inventory", """
SELECT repository, candidates, least(candidates, 20) AS selected, greatest(candidates - 20, 0) AS omitted FROM (
  SELECT r.repository, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {open_heads} h WHERE h.repository = r.repository AND h.branch = r.branch)) AS candidates
  FROM {branch_refs} r GROUP BY r.repository) c
""")
def _(t):
    return br.branch_inventory(t("branch_refs"), t("open_heads"))
