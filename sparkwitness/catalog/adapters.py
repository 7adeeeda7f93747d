"""Evidence tables derived from the given tables.

Shared by several families; adapters used once sit beside their query.  ``log_pos`` only has
to order commits, so it is computed from the date and key and needs no window.
"""

from .core import adapter

adapter("commits", """
SELECT concat('r', CAST(o_orderkey % 7 AS STRING)) AS repository,
       CAST(o_orderkey AS STRING) AS sha,
       CAST(30000000 - (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)) AS BIGINT)
           * 100000000000 - o_orderkey AS log_pos,
       concat(CASE WHEN o_orderpriority = '5-LOW' THEN 'Revert change ' ELSE 'Change ' END,
              CAST(o_orderkey % 13 AS STRING)) AS subject,
       o_orderkey % 11 = 0 AS is_merge
FROM {orders}
""")

adapter("part_path", """
SELECT p_partkey, concat(lower(p_type), '/', replace(p_brand, '#', ''), '.rs') AS path FROM {part}
""")

adapter("commit_paths", """
SELECT DISTINCT concat('r', CAST(l_orderkey % 7 AS STRING)) AS repository,
       CAST(l_orderkey AS STRING) AS sha, path
FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
""")

# Newest 100 per anchor before exclusions; a tight broad threshold gives both reasons.
adapter("cohort", """
SELECT repository, anchor, sha, log_pos, subject,
       reason IS NULL AS considered, reason, changed_paths
FROM (
  SELECT w.repository, w.anchor, w.sha, w.log_pos, w.subject, n.changed_paths,
         CASE WHEN lower(w.subject) LIKE 'revert%' THEN 'revert'
              WHEN n.changed_paths > 6 THEN 'broad' END AS reason
  FROM (SELECT p.repository, p.path AS anchor, c.sha, c.log_pos, c.subject,
               row_number() OVER (PARTITION BY p.repository, p.path ORDER BY c.log_pos) AS rn
        FROM {commit_paths} p JOIN {commits} c ON p.repository = c.repository AND p.sha = c.sha
        WHERE NOT c.is_merge) w
  JOIN (SELECT repository, sha, count(*) AS changed_paths FROM {commit_paths} GROUP BY repository, sha) n
    ON w.repository = n.repository AND w.sha = n.sha
  WHERE w.rn <= 100
) x
""")

adapter("change_pairs", """
SELECT DISTINCT s.repository, s.path AS source,
       concat(split_part(s.path, '/', 1), '/Brand',
              CAST(CAST(replace(replace(split_part(s.path, '/', 2), 'Brand', ''), '.rs', '') AS INT) % 25 + 1 AS STRING),
              '.rs') AS output
FROM {commit_paths} s
""")

adapter("source_commits", """
SELECT repository, sha, concat('p', sha) AS parent_sha, path FROM {commit_paths}
""")

# Both versions of a line's file from one read; UNPIVOT leaves out the version that does not exist.
adapter("file_versions", """
SELECT repository, CASE WHEN side = 'before_line' THEN concat('p', sha) ELSE sha END AS sha, path, concat('f', CAST(version AS STRING)) AS fingerprint
FROM (SELECT concat('r', CAST(l_orderkey % 7 AS STRING)) AS repository, CAST(l_orderkey AS STRING) AS sha, path,
             min(CASE WHEN l_linenumber < 7 THEN CAST(l_linenumber AS INT) END) AS after_line,
             min(CASE WHEN l_quantity > 2 THEN CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS INT) ELSE 0 END END) AS before_line
      FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
      GROUP BY l_orderkey, path) v
UNPIVOT (version FOR side IN (after_line, before_line))
""")

adapter("classified", """
SELECT s.repository, s.sha, s.path,
       CASE WHEN a.fingerprint IS NULL OR b.fingerprint IS NULL THEN 'unclassified'
            WHEN a.fingerprint = b.fingerprint THEN 'comments_or_docs_only'
            ELSE 'syntax_changed' END AS change_class
FROM {source_commits} s
LEFT JOIN {file_versions} a ON s.repository = a.repository AND s.sha = a.sha AND s.path = a.path
LEFT JOIN {file_versions} b ON s.repository = b.repository AND s.parent_sha = b.sha AND s.path = b.path
""")

adapter("history_targets", """
SELECT DISTINCT repository, path AS target, split_part(path, '/', 1) AS scope FROM {commit_paths}
""")

# Keys counted from 1: a work reference is a positive number.
adapter("numbered_orders", "SELECT o_orderkey + 1 AS o_orderkey, o_custkey, o_orderstatus FROM {orders}")
adapter("numbered_lines", "SELECT l_orderkey + 1 AS l_orderkey, l_partkey FROM {lineitem}")
adapter("work_items", """
SELECT CAST(o_orderkey % 50 AS STRING) AS snapshot_id, concat('#', CAST(o_orderkey AS STRING)) AS id,
       'pull_request' AS kind, concat('Change ', CAST(o_orderkey AS STRING)) AS title,
       CAST(o_orderkey % 200 AS STRING) AS head_sha,
       CASE o_orderstatus WHEN 'F' THEN 'confirmed_active' WHEN 'O' THEN 'preparation' ELSE 'unresolved' END AS activity
FROM {numbered_orders}
""")

adapter("work_paths", """
SELECT DISTINCT CAST(l_orderkey % 50 AS STRING) AS snapshot_id, concat('#', CAST(l_orderkey AS STRING)) AS id, path
FROM {numbered_lines} JOIN {part_path} ON l_partkey = p_partkey
""")

# The reference model: one current item per snapshot.
adapter("currents", """
SELECT CAST(o_orderkey % 50 AS STRING) AS snapshot_id, concat('#', CAST(min(o_orderkey) AS STRING)) AS id
FROM {numbered_orders} GROUP BY o_orderkey % 50
""")
