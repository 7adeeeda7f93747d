"""Project memory and decisions."""

from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import memory as mem
from .core import adapter, query

# Artifact texts with every relation form, near misses and a primary-case block.
adapter("artifacts", """
SELECT concat('Org/r', CAST(o_orderkey - o_orderkey % 64 AS STRING)) AS repository,
       CASE WHEN o_orderkey % 4 = 0 THEN 'issue' ELSE 'pull_request' END AS kind, o_orderkey + 1 AS number,
       o_orderkey % 5 <> 0 AS merged, o_orderkey % 6 <> 0 AS evidence_complete,
       concat('Summary of ', o_orderpriority, chr(10),
         CASE WHEN o_orderkey % 2 = 0 THEN concat('  Closes #', CAST(o_orderkey + 8 AS STRING), ' and #', CAST(o_orderkey + 15 AS STRING), chr(13), chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 3 = 0 THEN concat('Follow-up to #', CAST(o_orderkey + 3 AS STRING), ', see x#4 and #05', chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 5 = 0 THEN concat('Related: #', CAST(o_orderkey + 29 AS STRING), chr(10), 'Related: #', CAST(o_orderkey + 29 AS STRING), chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 7 = 0 THEN concat('parent: #', CAST(o_orderkey + 50 AS STRING), chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 11 = 0 THEN concat('Deployment continuation #', CAST(o_orderkey + 22 AS STRING), chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 13 = 0 THEN concat('closes: #', CAST(o_orderkey + 1 AS STRING), chr(10), 'fixes', chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 9 = 0 THEN concat('Primary case:', chr(10), chr(10), '  https://github.com/',
              CASE o_orderkey % 4 WHEN 0 THEN concat('org/R', CAST(o_orderkey - o_orderkey % 64 AS STRING)) WHEN 1 THEN concat('Org/r', CAST(o_orderkey - o_orderkey % 64 AS STRING)) ELSE 'Org/r9' END,
              '/issues/', CAST(o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 7 END AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '#top' ELSE '' END, chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 17 = 0 THEN concat('PRIMARY CASE:', chr(10), 'see the list', chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 19 = 0 THEN 'primary case:' ELSE 'end' END) AS evidence_text
FROM {orders}
""")
adapter("artifact_paths", """
SELECT DISTINCT a.repository, a.kind, a.number, p.path FROM {artifacts} a JOIN {lineitem} l ON l.l_orderkey + 1 = a.number
JOIN {part_path} p ON l.l_partkey = p.p_partkey
UNION ALL
SELECT repository, kind, number, 'src/shared.rs' AS path FROM {artifacts} WHERE number % 10 <> 3
""")

LINES = """
SELECT repository, kind, number, unnest(string_split(replace(evidence_text, concat(chr(13), chr(10)), chr(10)), chr(10))) AS raw FROM {artifacts}
"""
RELATION = """CASE WHEN regexp_matches(lower(line), '^(closes|close|closed|fixes|fix|fixed|resolves|resolve|resolved)\\s') THEN 'closes'
  WHEN starts_with(lower(line), 'follow-up to') OR starts_with(lower(line), 'follow up to') THEN 'follow_up_to'
  WHEN starts_with(lower(line), 'continuation from') OR starts_with(lower(line), 'deployment continuation') THEN 'continuation_from'
  WHEN starts_with(lower(line), 'parent:') THEN 'parent' WHEN starts_with(lower(line), 'related:') THEN 'related' END"""
EDGES = f"""
SELECT e.repository, e.kind AS from_kind, e.number AS from_number, e.relation, a.kind AS to_kind, e.to_number, e.line
FROM (SELECT DISTINCT repository, kind, number, line, relation, CAST(ref AS BIGINT) AS to_number
      FROM (SELECT *, {RELATION} AS relation, unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9_.-])#([1-9][0-9]*)\\b', 1)) AS ref
            FROM (SELECT repository, kind, number, trim(raw) AS line FROM ({LINES}) l) t) r WHERE relation IS NOT NULL) e
LEFT JOIN {{artifacts}} a ON a.repository = e.repository AND a.number = e.to_number
"""


@query("mem_1_artifact_edges", EDGES)
def _(t):
    return mem.artifact_edges(t("artifacts"))


@query("mem_2_primary_case_edges", f"""
WITH l AS (SELECT repository, kind, number, trim(raw) AS line, idx FROM (
             SELECT repository, kind, number, unnest(string_split(evidence_text, chr(10))) AS raw,
                    unnest(range(1, len(string_split(evidence_text, chr(10))) + 1)) AS idx FROM {{artifacts}}) x
           WHERE trim(replace(raw, chr(13), '')) <> ''),
p AS (SELECT *, lead(line) OVER (PARTITION BY repository, kind, number ORDER BY idx) AS target FROM l),
b AS (SELECT *, regexp_extract(target, '(?i)^https://(?:redirect\\.)?github\\.com/([^/]+/[^/]+)/issues/([1-9][0-9]*)(?:[/?#].*)?$', ['r', 'n']) AS m
      FROM p WHERE lower(line) = 'primary case:')
SELECT DISTINCT repository, kind AS from_kind, number AS from_number, TRY_CAST(m.n AS BIGINT) AS to_number,
       CASE WHEN target IS NULL THEN 'no_target' WHEN m.n = '' THEN 'not_an_issue_url' WHEN lower(m.r) <> lower(repository) THEN 'escapes_repository'
            WHEN TRY_CAST(m.n AS BIGINT) = number THEN 'self_reference' ELSE 'edge' END AS state
FROM b
""")
def _(t):
    return mem.primary_case_edges(t("artifacts"))


# Claimed edges: the text's own lines, some altered so that each rule fails somewhere.
adapter("claimed_edges", """
SELECT repository, kind AS from_kind, number AS from_number,
       CASE WHEN number % 7 = 0 THEN 'parent' ELSE 'follow_up_to' END AS relation, 'pull_request' AS to_kind,
       number + CASE WHEN number % 5 = 0 THEN 1 ELSE 2 END AS to_number,
       CASE WHEN number % 11 = 0 THEN concat('Follow-up to #', CAST(number AS STRING)) WHEN number % 13 = 0 THEN 'Summary of'
            ELSE concat('Follow-up to #', CAST(number + 2 AS STRING), ', see x#4 and #05') END AS evidence
FROM {artifacts} WHERE (number - 1) % 3 = 0
UNION ALL
SELECT repository, kind, number, CASE WHEN number % 5 = 0 THEN 'parent' ELSE 'related' END, 'pull_request', number + CASE WHEN number % 8 = 2 THEN 5 ELSE 6 END,
       concat('Primary case:', chr(10), chr(10), '  https://github.com/', CASE (number - 1) % 4 WHEN 1 THEN repository ELSE 'Org/r9' END, '/issues/',
              CAST(number + 6 AS STRING), CASE WHEN (number - 1) % 2 = 0 THEN '#top' ELSE '' END)
FROM {artifacts} WHERE (number - 1) % 9 = 0
UNION ALL
SELECT repository, kind, number, 'related', kind, number, 'Related: #1' FROM {artifacts} WHERE number % 50 = 0
UNION ALL
SELECT repository, 'commit', number, 'related', kind, number, 'Related: #1' FROM {artifacts} WHERE number % 50 = 1
""")


@query("mem_3_edge_semantics", f"""
SELECT * FROM (
  SELECT e.*, CASE WHEN e.from_kind = e.to_kind AND e.from_number = e.to_number THEN 'self_reference'
      WHEN s.number IS NULL THEN 'source_absent' WHEN d.number IS NULL THEN 'target_absent'
      WHEN NOT contains(s.evidence_text, e.evidence) THEN 'evidence_not_in_source'
      WHEN contains(e.evidence, chr(10)) THEN
        CASE WHEN lower(url.r) <> lower(e.repository) OR url.n = '' THEN 'not_a_primary_case_block'
             WHEN e.relation <> 'related' THEN 'primary_case_relation' WHEN CAST(url.n AS BIGINT) <> e.to_number THEN 'primary_case_target' END
      WHEN e.line_relation IS NULL THEN 'not_a_relation_line' WHEN e.line_relation <> e.relation THEN 'relation_disagrees'
      WHEN NOT list_contains(regexp_extract_all(e.evidence, '#([1-9][0-9]*)', 1), CAST(e.to_number AS VARCHAR)) THEN 'target_not_mentioned' END AS reason
  FROM (SELECT *, {RELATION.replace('line', 'evidence')} AS line_relation,
               regexp_extract(evidence, '(?i)^primary case:\\s+https://github\\.com/([^/]+/[^/]+)/issues/([1-9][0-9]*)', ['r', 'n']) AS url FROM {{claimed_edges}}) e
  LEFT JOIN {{artifacts}} s ON s.repository = e.repository AND s.kind = e.from_kind AND s.number = e.from_number
  LEFT JOIN {{artifacts}} d ON d.repository = e.repository AND d.kind = e.to_kind AND d.number = e.to_number) v
WHERE reason IS NOT NULL
""".replace("SELECT * FROM (\n  SELECT e.*,", "SELECT repository, from_kind, from_number, relation, to_kind, to_number, evidence, reason FROM (\n  SELECT e.*,"))
def _(t):
    return mem.edge_semantics(t("artifacts"), t("claimed_edges"))


adapter("memory_anchors", """
SELECT repository, kind, number FROM {artifacts} WHERE merged
""")


@query("mem_4_memory_summary", f"""
WITH e AS ({EDGES})
SELECT n.repository, n.kind, n.number, a.n AS artifacts, coalesce(g.n, 0) AS edges, coalesce(p.n, 0) AS changed_paths, coalesce(o.n, 0) AS outgoing_links
FROM {{memory_anchors}} n JOIN (SELECT repository, count(*) AS n FROM {{artifacts}} GROUP BY repository) a ON a.repository = n.repository
LEFT JOIN (SELECT repository, count(*) AS n FROM e GROUP BY repository) g ON g.repository = n.repository
LEFT JOIN (SELECT repository, kind, number, count(*) AS n FROM {{artifact_paths}} GROUP BY ALL) p ON p.repository = n.repository AND p.kind = n.kind AND p.number = n.number
LEFT JOIN (SELECT repository, from_kind, from_number, count(*) AS n FROM e GROUP BY ALL) o ON o.repository = n.repository AND o.from_kind = n.kind AND o.from_number = n.number
""")
def _(t):
    edges = mem.artifact_edges(t("artifacts"))
    return mem.memory_summary(t("artifacts"), t("artifact_paths"), edges, t("memory_anchors"))


def _lineage(t):
    edges = mem.artifact_edges(t("artifacts")).where("to_kind IS NOT NULL AND to_number <> from_number")
    return mem.lineage(edges, t("memory_anchors"), 3)


REACHED = f"""
WITH RECURSIVE links AS (SELECT DISTINCT repository, from_number, to_number FROM ({EDGES}) e WHERE to_kind IS NOT NULL AND to_number <> from_number),
walk AS (SELECT repository, number AS anchor, number, 0 AS depth FROM {{memory_anchors}}
         UNION SELECT w.repository, w.anchor, l.to_number, w.depth + 1 FROM walk w JOIN links l ON l.repository = w.repository AND l.from_number = w.number WHERE w.depth < 3),
reached AS (SELECT repository, anchor, number, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY repository, anchor, number)
"""


@query("mem_5_lineage", REACHED + "SELECT * FROM reached")
def _(t):
    return _lineage(t)


RECEIPTS = """SELECT * FROM (SELECT r.repository, r.anchor, r.number, CASE WHEN r.depth = 3 THEN 'depth_frontier'
  WHEN NOT a.evidence_complete THEN 'incomplete_evidence' END AS receipt
  FROM reached r JOIN {artifacts} a ON a.repository = r.repository AND a.number = r.number) q WHERE receipt IS NOT NULL"""


@query("mem_5_lineage_receipts", REACHED + RECEIPTS)
def _(t):
    return mem.lineage_receipts(_lineage(t), t("artifacts"), 3)


@query("mem_5_lineage_completeness", REACHED + f""", q AS ({RECEIPTS})
SELECT r.repository, r.anchor, count(*) AS artifacts,
       NOT EXISTS (SELECT 1 FROM q WHERE q.receipt = 'incomplete_evidence' AND q.repository = r.repository AND q.anchor = r.anchor) AS complete_within_requested_depth
FROM reached r GROUP BY r.repository, r.anchor
""")
def _(t):
    reached = _lineage(t)
    return mem.lineage_completeness(reached, mem.lineage_receipts(reached, t("artifacts"), 3))


# Whole conversation texts; the path sits behind a blank line in most of them.
adapter("path_texts", """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS doc,
       concat(text, chr(10), '  ', chr(10), CASE WHEN turn % 3 = 0 THEN '' ELSE concat('see docs/', CAST(conv_id % 10 AS STRING), '.md now', chr(10)) END, role) AS text
FROM {conversations}
""")
adapter("path_questions", """
SELECT doc, 'docs/3.md' AS path FROM {path_texts}
UNION ALL
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS doc, concat('docs/', CAST(conv_id % 10 AS STRING), '.md') AS path
FROM {conversations} WHERE conv_id % 10 <> 3
""")


@query("mem_6_evidence_for_path", """
WITH l AS (SELECT doc, idx, s FROM (SELECT doc, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS idx, unnest(string_split(text, chr(10))) AS s FROM {path_texts}) x),
h AS (SELECT q.doc, q.path, min(l.idx) AS line FROM {path_questions} q LEFT JOIN l ON l.doc = q.doc AND contains(l.s, q.path) GROUP BY q.doc, q.path),
s AS (SELECT h.doc, h.path, h.line, coalesce(max(l.idx), h.line) AS start FROM h LEFT JOIN l ON l.doc = h.doc AND l.idx < h.line AND trim(l.s) <> '' GROUP BY h.doc, h.path, h.line)
SELECT s.doc, s.path, s.line, CASE WHEN s.line IS NOT NULL THEN string_agg(l.s, chr(10) ORDER BY l.idx) END AS evidence
FROM s LEFT JOIN l ON l.doc = s.doc AND l.idx BETWEEN s.start AND s.line GROUP BY s.doc, s.path, s.line
""")
def _(t):
    return mem.evidence_for_path(t("path_texts"), t("path_questions"))


adapter("project_documents", """
SELECT source AS repository, lang AS revision, concat('docs/', CAST(doc_id AS STRING), '.md') AS path, CAST(doc_id AS STRING) AS blob_sha,
       text, n_chars < 3000 AS text_complete, 'tree' AS source FROM {documents}
""")


@query("mem_7_document_summary", """
SELECT repository, revision, path, blob_sha, CAST(strlen(text) AS BIGINT) AS text_bytes, text_complete, source FROM {project_documents}
""")
def _(t):
    return mem.document_summary(t("project_documents"))


@query("mem_7_document_counts", """
SELECT repository, revision, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes,
       count(*) FILTER (WHERE NOT text_complete) AS incomplete FROM {project_documents} GROUP BY repository, revision
""")
def _(t):
    return mem.document_counts(t("project_documents"))


adapter("decision_rows", """
SELECT concat('r', CAST(p_partkey % 7 AS STRING)) AS repository, concat('d', CAST(p_partkey AS STRING)) AS decision_id,
       CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN path WHEN 2 THEN concat('old/', CAST(p_size AS STRING)) ELSE concat(lower(p_type), '/Brand') END AS path_prefix
FROM {part} p JOIN (SELECT p_partkey AS k, path FROM {part_path}) q ON p.p_partkey = q.k
""")
adapter("decision_targets", "SELECT DISTINCT repository, path AS target FROM {commit_paths}")

COVERS = "({p} = d.path_prefix OR starts_with({p}, concat(d.path_prefix, '/')))"
DIRECT = f"""SELECT t.repository, t.target, d.decision_id, d.path_prefix, 'direct' AS matched_via, t.target AS matched_path
FROM {{decision_targets}} t JOIN {{decision_rows}} d ON d.repository = t.repository AND {COVERS.replace('{p}', 't.target')}"""


@query("dec_1_decisions_for", DIRECT)
def _(t):
    return dec.decisions_for(t("decision_rows"), t("decision_targets"))


# Rename chains of up to 32 steps: each order is one step of the file that 32 orders share.
adapter("renames", """
SELECT concat('r', CAST(o_orderkey - o_orderkey % 512 AS STRING)) AS repository,
       concat('old/', CAST((o_orderkey % 32 + 1) % 12 AS STRING), '/f', CAST(o_orderkey - o_orderkey % 32 AS STRING), '-', CAST(o_orderkey % 32 + 1 AS STRING), '.rs') AS old_path,
       CASE WHEN o_orderkey % 32 = 0 THEN concat('src/f', CAST(o_orderkey AS STRING), '.rs')
            ELSE concat('old/', CAST(o_orderkey % 32 % 12 AS STRING), '/f', CAST(o_orderkey - o_orderkey % 32 AS STRING), '-', CAST(o_orderkey % 32 AS STRING), '.rs') END AS new_path
FROM {orders} WHERE o_orderkey % 101 <> 100
""")
adapter("moved_targets", """
SELECT concat('r', CAST(o_orderkey - o_orderkey % 512 AS STRING)) AS repository, concat('src/f', CAST(o_orderkey AS STRING), '.rs') AS target
FROM {orders} WHERE o_orderkey % 32 = 0
""")
adapter("moved_decisions", """
SELECT concat('r', CAST(p_partkey * 7 - p_partkey * 7 % 512 AS STRING)) AS repository, concat('d', CAST(p_partkey AS STRING)) AS decision_id,
       CASE p_size % 5 WHEN 0 THEN 'src' WHEN 1 THEN concat('old/', CAST(p_size % 12 AS STRING)) WHEN 2 THEN 'old' WHEN 3 THEN concat('src/f', CAST(p_partkey * 7 - p_partkey * 7 % 32 AS STRING), '.rs') ELSE 'none' END AS path_prefix
FROM {part}
""")


@query("dec_2_decisions_via_lineage", f"""
WITH RECURSIVE walk AS (
  SELECT t.repository, t.target, r.old_path AS path FROM {{moved_targets}} t JOIN {{renames}} r ON r.repository = t.repository AND r.new_path = t.target
  UNION SELECT w.repository, w.target, r.old_path FROM walk w JOIN {{renames}} r ON r.repository = w.repository AND r.new_path = w.path),
direct AS (SELECT t.repository, t.target, d.decision_id, d.path_prefix, 'direct' AS matched_via, t.target AS matched_path
  FROM {{moved_targets}} t JOIN {{moved_decisions}} d ON d.repository = t.repository AND {COVERS.replace('{p}', 't.target')})
SELECT * FROM direct
UNION ALL
SELECT w.repository, w.target, d.decision_id, d.path_prefix, 'git_file_lineage', min(w.path)
FROM walk w JOIN {{moved_decisions}} d ON d.repository = w.repository AND {COVERS.replace('{p}', 'w.path')}
WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.repository = w.repository AND x.target = w.target AND x.decision_id = d.decision_id)
GROUP BY w.repository, w.target, d.decision_id, d.path_prefix
""")
def _(t):
    return dec.decisions_via_lineage(t("moved_decisions"), t("moved_targets"), t("renames"))


adapter("guidance_files", """
SELECT DISTINCT concat('r', CAST(p_partkey % 7 AS STRING)) AS repository,
       concat(CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN concat(lower(p_type), '/') ELSE concat(lower(p_type), '/x/') END,
              CASE p_size % 4 WHEN 0 THEN 'AGENTS.md' WHEN 1 THEN 'CONTRIBUTING.md' ELSE 'README.md' END) AS path
FROM {part}
""")


@query("dec_3_guidance_for", """
WITH g AS (SELECT repository, path, regexp_extract(path, '([^/]+)$', 1) AS guidance_kind, regexp_replace(path, '/?[^/]+$', '') AS scope FROM {guidance_files})
SELECT t.repository, t.target, g.path, g.guidance_kind, g.scope,
       CASE WHEN g.scope = '' THEN 0 ELSE len(string_split(g.scope, '/')) END AS depth
FROM {decision_targets} t JOIN g ON g.repository = t.repository AND (g.scope = '' OR starts_with(t.target, concat(g.scope, '/')))
WHERE g.guidance_kind IN ('AGENTS.md', 'CONTRIBUTING.md')
""")
def _(t):
    return dec.guidance_for(t("guidance_files"), t("decision_targets"))
