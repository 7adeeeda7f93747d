"""History family."""

from pyspark.sql import functions as F

from ..operators import history as op
from ..plans.durable import kept
from .core import adapter, query

joined = lambda c: F.array_join(c, ",").alias(c)


@query("hist_1_anchor_cohort", "SELECT * FROM {cohort}")
def _(t):
    return op.anchor_cohort(t("commits"), t("commit_paths"), max_commits=100, max_paths=6)


def _cohort(t):
    return op.anchor_cohort(t("commits"), t("commit_paths"), max_commits=100, max_paths=6)


def _tagged(t, cohort=None):
    return op.tagged_cohort(cohort or kept(_cohort(t), "cohort"), t("source_commits"), t("file_versions"))


COMPANIONS = """
SELECT s.repository, s.anchor, s.path, s.support, o.opportunities,
       round(1000.0 * s.support / o.opportunities) / 10.0 AS support_percent
FROM (SELECT k.repository, k.anchor, p.path, count(*) AS support
      FROM (SELECT * FROM {cohort} WHERE considered) k
      JOIN {commit_paths} p ON k.repository = p.repository AND k.sha = p.sha
      WHERE p.path <> k.anchor GROUP BY k.repository, k.anchor, p.path) s
JOIN (SELECT repository, anchor, count(*) AS opportunities FROM {cohort} WHERE considered
      GROUP BY repository, anchor) o ON s.repository = o.repository AND s.anchor = o.anchor
"""


@query("hist_2_companions", """
WITH kept AS (SELECT * FROM {cohort} WHERE considered),
base AS (""" + COMPANIONS + """),
flagged AS (
  SELECT b.repository, b.anchor, b.path, k.sha, k.log_pos, p.sha IS NOT NULL AS present
  FROM base b JOIN kept k ON b.repository = k.repository AND b.anchor = k.anchor
  LEFT JOIN {commit_paths} p ON p.repository = k.repository AND p.sha = k.sha AND p.path = b.path),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repository, anchor, path, present ORDER BY log_pos) AS rn FROM flagged),
examples AS (
  SELECT repository, anchor, path,
         coalesce(string_agg(sha, ',' ORDER BY log_pos) FILTER (WHERE present AND rn <= 3), '') AS examples,
         coalesce(string_agg(sha, ',' ORDER BY log_pos) FILTER (WHERE NOT present AND rn <= 3), '') AS counterexamples
  FROM ranked GROUP BY repository, anchor, path)
SELECT b.*, e.examples, e.counterexamples
FROM base b JOIN examples e ON b.repository = e.repository AND b.anchor = e.anchor AND b.path = e.path
""")
def _(t):
    rows = op.companions(_cohort(t), t("commit_paths"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ["examples", "counterexamples"]})


@query("hist_3_directional_pairs", """
WITH base AS MATERIALIZED (""" + COMPANIONS + """)
SELECT a.repository, a.anchor, a.path, a.support, a.opportunities, a.support_percent,
       b.support AS reverse_support, b.opportunities AS reverse_opportunities, b.support_percent AS reverse_percent
FROM base a LEFT JOIN base b ON a.repository = b.repository AND a.anchor = b.path AND a.path = b.anchor
""")
def _(t):
    return op.directional_pairs(op.companions(_cohort(t), t("commit_paths")))


# Whole documents become files; a marker line is put on a line that depends on the key.
adapter("marked_files", """
SELECT source AS repository, concat('docs/', CAST(doc_id AS STRING), '.txt') AS path,
       concat(CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('// header', chr(10), '', chr(10)) END,
              CASE doc_id % 5 WHEN 0 THEN '  // This file is @GENERATED by a tool  '
                              WHEN 1 THEN '# Do Not Edit' WHEN 2 THEN '/* automatically generated */'
                              WHEN 3 THEN '-- Auto-Generated' ELSE '// plain' END,
              chr(10), text) AS content
FROM {documents}
""")


@query("hist_4_generated_markers", """
WITH lines AS (
  SELECT repository, path, unnest(string_split(CAST(content AS VARCHAR), chr(10))) AS line_text,
         unnest(range(1, len(string_split(CAST(content AS VARCHAR), chr(10))) + 1)) AS line
  FROM {marked_files}),
hits AS (
  SELECT repository, path, min(line) AS line FROM lines
  WHERE line <= 40 AND (contains(lower(line_text), '@generated') OR contains(lower(line_text), 'do not edit')
        OR contains(lower(line_text), 'automatically generated') OR contains(lower(line_text), 'auto-generated'))
  GROUP BY repository, path)
SELECT h.repository, h.path, h.line, trim(l.line_text) AS marker
FROM hits h JOIN lines l ON h.repository = l.repository AND h.path = l.path AND h.line = l.line
""")
def _(t):
    return op.generated_markers(t("marked_files"))


@query("hist_5_change_classes", "SELECT * FROM {classified}")
def _(t):
    return op.classify_changes(t("source_commits"), t("file_versions"))


adapter("class_cohort", """
SELECT p.repository, p.source, p.output,
       count(*) FILTER (WHERE k.change_class = 'syntax_changed') AS opportunities,
       count(*) FILTER (WHERE k.change_class = 'syntax_changed' AND o.sha IS NOT NULL) AS support,
       count(*) FILTER (WHERE k.change_class = 'comments_or_docs_only') AS comments_or_docs_only,
       count(*) FILTER (WHERE k.change_class = 'unclassified') AS unclassified
FROM {change_pairs} p
LEFT JOIN (SELECT h.repository, h.anchor, h.sha, c.change_class FROM {cohort} h
           JOIN {classified} c ON h.repository = c.repository AND h.sha = c.sha AND h.anchor = c.path
           WHERE h.considered) k ON p.repository = k.repository AND p.source = k.anchor
LEFT JOIN {commit_paths} o ON o.repository = k.repository AND o.sha = k.sha AND o.path = p.output
GROUP BY p.repository, p.source, p.output
""")


@query("hist_6_class_cohort", """
WITH hits AS (
  SELECT p.repository, p.source, p.output, h.sha, h.log_pos,
         row_number() OVER (PARTITION BY p.repository, p.source, p.output ORDER BY h.log_pos) AS rn
  FROM {change_pairs} p
  JOIN {cohort} h ON p.repository = h.repository AND p.source = h.anchor AND h.considered
  JOIN {classified} c ON h.repository = c.repository AND h.sha = c.sha AND h.anchor = c.path
       AND c.change_class = 'syntax_changed'
  JOIN {commit_paths} o ON o.repository = h.repository AND o.sha = h.sha AND o.path = p.output)
SELECT k.*, coalesce(e.examples, '') AS examples
FROM {class_cohort} k LEFT JOIN (
  SELECT repository, source, output, string_agg(sha, ',' ORDER BY log_pos) AS examples
  FROM hits WHERE rn <= 3 GROUP BY repository, source, output) e
  ON k.repository = e.repository AND k.source = e.source AND k.output = e.output
""")
def _(t):
    tagged = kept(_tagged(t), "tagged")
    rows = op.class_cohort(tagged, t("commit_paths"), t("change_pairs"))
    return rows.withColumn("examples", F.array_join("examples", ","))


@query("hist_7_cohort_compare", """
WITH tagged AS (
  SELECT h.repository, h.anchor AS source, h.sha, coalesce(c.change_class = 'syntax_changed', false) AS syntax
  FROM {cohort} h LEFT JOIN {classified} c ON h.repository = c.repository AND h.sha = c.sha AND h.anchor = c.path
  WHERE h.considered),
totals AS (SELECT repository, source, count(*) AS all_opportunities, count(*) FILTER (WHERE syntax) AS class_opportunities
           FROM tagged GROUP BY repository, source),
counts AS (SELECT t.repository, t.source, p.path, count(*) AS all_support, count(*) FILTER (WHERE syntax) AS class_support
           FROM tagged t JOIN {commit_paths} p ON t.repository = p.repository AND t.sha = p.sha
           WHERE p.path <> t.source GROUP BY t.repository, t.source, p.path),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repository, source ORDER BY class_support DESC, all_support DESC, path) AS rank,
                  count(*) OVER (PARTITION BY repository, source) AS n
           FROM counts WHERE class_support > 0)
SELECT r.repository, r.source, r.path, r.rank, r.class_support, o.class_opportunities, r.all_support, o.all_opportunities, greatest(r.n - 15, 0) AS omitted
FROM ranked r JOIN totals o ON r.repository = o.repository AND r.source = o.source WHERE r.rank <= 15
""")
def _(t):
    return op.cohort_compare(_tagged(t), t("commit_paths"))


@query("hist_7_cohort_counts", """
SELECT h.repository, h.anchor AS source, count(*) AS discovered, count(*) FILTER (h.considered) AS focused,
       count(*) FILTER (h.considered AND c.change_class = 'syntax_changed') AS syntax_changed,
       count(*) FILTER (h.considered AND c.change_class = 'comments_or_docs_only') AS comments_or_docs_only,
       count(*) FILTER (h.considered AND c.change_class = 'unclassified') AS unclassified,
       count(*) FILTER (h.reason = 'revert') AS excluded_reverts, count(*) FILTER (h.reason = 'broad') AS excluded_broad
FROM {cohort} h LEFT JOIN {classified} c ON h.repository = c.repository AND h.sha = c.sha AND h.anchor = c.path
GROUP BY h.repository, h.anchor
""")
def _(t):
    cohort = kept(_cohort(t), "cohort")  # read twice
    return op.cohort_counts(cohort, _tagged(t, cohort))


adapter("recent_window", """
SELECT repository, target, sha, log_pos, subject, n > 20 AS truncated
FROM (SELECT p.repository, p.path AS target, c.sha, c.log_pos, c.subject,
             row_number() OVER (PARTITION BY p.repository, p.path ORDER BY c.log_pos) AS rn,
             count(*) OVER (PARTITION BY p.repository, p.path) AS n
      FROM {commit_paths} p JOIN {commits} c ON p.repository = c.repository AND p.sha = c.sha
      WHERE NOT c.is_merge) x
WHERE rn <= 20
""")


@query("hist_8_recent_history", "SELECT * FROM {recent_window}")
def _(t):
    return op.recent_history(t("commits"), t("commit_paths"), t("history_targets"))


@query("hist_8_scope_history", """
WITH touched AS (SELECT DISTINCT p.repository, split_part(p.path, '/', 1) AS scope, p.sha FROM {commit_paths} p),
win AS (SELECT t.repository, t.scope, c.sha, c.log_pos,
               row_number() OVER (PARTITION BY t.repository, t.scope ORDER BY c.log_pos) AS rn,
               count(*) OVER (PARTITION BY t.repository, t.scope) AS n
        FROM touched t JOIN {commits} c ON t.repository = c.repository AND t.sha = c.sha WHERE NOT c.is_merge)
SELECT h.repository, h.target, h.scope, w.sha, w.log_pos, w.n > 20 AS truncated
FROM {history_targets} h JOIN win w ON h.repository = w.repository AND h.scope = w.scope AND w.rn <= 20
WHERE NOT EXISTS (SELECT 1 FROM {recent_window} r
                  WHERE r.repository = h.repository AND r.target = h.target AND r.sha = w.sha)
""")
def _(t):
    return op.scope_history(t("commits"), t("commit_paths"), t("history_targets"))


adapter("task_paths", """
SELECT concat('t', CAST(l_orderkey AS STRING)) AS task,
       concat('src/', CASE WHEN l_orderkey % 3 = 0 THEN 'core/' ELSE '' END,
              CASE WHEN l_orderkey % 5 = 0 THEN 'api/v1/f' ELSE concat(lower(p_type), '/f') END,
              CAST(l_linenumber AS STRING), '.rs') AS path
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
UNION ALL
SELECT concat('m', CAST(o_custkey AS STRING)) AS task,
       concat(lower(o_orderstatus), '/', o_orderpriority, '.md') AS path
FROM {orders}
""")


@query("hist_9_common_directory", """
WITH d AS (SELECT DISTINCT task, path FROM {task_paths}),
parts AS (SELECT task, path, string_split(path, '/') AS p FROM d),
dirs AS (SELECT task, path, array_to_string(p[1:i], '/') AS dir
         FROM (SELECT task, path, p, unnest(range(1, len(p))) AS i FROM parts)),
n AS (SELECT task, count(*) AS paths FROM d GROUP BY task),
shared AS (SELECT dirs.task, dir FROM dirs JOIN n ON dirs.task = n.task GROUP BY dirs.task, dir, paths HAVING count(*) = paths)
SELECT n.task, CASE WHEN n.paths >= 2 THEN s.scope END AS scope, n.paths
FROM n LEFT JOIN (SELECT task, arg_max(dir, length(dir)) AS scope FROM shared GROUP BY task) s ON n.task = s.task
""")
def _(t):
    return op.common_directory(t("task_paths"))


adapter("required_subjects", """
SELECT repository, target, concat('change ', CAST(length(target) % 13 AS STRING)) AS subject FROM {history_targets}
UNION ALL
SELECT repository, target, 'Revert' AS subject FROM {history_targets}
""")


@query("hist_10_subject_presence", """
SELECT q.repository, q.target, q.subject, coalesce(bool_or(contains(r.subject, q.subject)), false) AS present
FROM {required_subjects} q LEFT JOIN {recent_window} r ON q.repository = r.repository AND q.target = r.target
GROUP BY q.repository, q.target, q.subject
""")
def _(t):
    window = op.recent_history(t("commits"), t("commit_paths"), t("history_targets"))
    return op.subject_presence(t("required_subjects"), window)
