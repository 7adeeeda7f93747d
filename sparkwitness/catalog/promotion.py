"""Promotion receipts and base lineage."""

from pyspark.sql import functions as F

from ..operators import promotion as op
from . import sqlparts as sq
from .core import adapter, query

# One promotion per order; the next order of the same customer group moved the base.
adapter("promotions", """
SELECT CAST(o_orderkey AS STRING) AS promotion_id, o_orderkey % 17 = 0 AS conflict, o_orderkey % 13 <> 0 AS mergeable,
       'c1' AS tested_change_set, CASE WHEN o_orderkey % 11 = 0 THEN 'c2' ELSE 'c1' END AS current_change_set,
       concat('m', CAST(o_orderkey AS STRING)) AS tested_merge_tree,
       concat('m', CAST(o_orderkey + CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE 1 END AS STRING)) AS current_merge_tree,
       concat('t', CAST(o_orderkey AS STRING)) AS tested_base_tree,
       concat('t', CAST(o_orderkey + CASE WHEN o_custkey % 8 = 0 THEN 0 ELSE 1 END AS STRING)) AS current_base_tree,
       'b1' AS tested_base_sha, 'b2' AS current_base_sha,
       CASE WHEN o_custkey % 4 = 0 THEN 'b1' WHEN o_custkey % 4 = 1 THEN 'b2' ELSE 'b0' END AS merge_base_sha,
       o_orderstatus <> 'P' AS scope_complete
FROM {orders}
""")
adapter("declared_paths", """
SELECT DISTINCT CAST(l_orderkey AS STRING) AS promotion_id,
       CASE WHEN l_linenumber < 4 THEN 'branch_path' WHEN l_linenumber < 6 THEN 'consumed_contract' ELSE 'applicable_policy' END AS kind,
       CASE WHEN l_linenumber % 7 = 3 THEN split_part(path, '/', 1) ELSE path END AS declared_path
FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
""")
adapter("intervening_paths", """
SELECT DISTINCT CAST(l_orderkey - 1 AS STRING) AS promotion_id, concat('s', CAST(l_suppkey % 3 AS STRING)) AS commit_sha,
       CASE WHEN l_quantity < 3 THEN split_part(path, '/', 1) ELSE path END AS changed_path
FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
""")
OVER = """(a.changed_path = d.declared_path OR starts_with(a.changed_path, concat(d.declared_path, '/'))
   OR starts_with(d.declared_path, concat(a.changed_path, '/')))"""


def _overlaps(t):
    return op.promotion_overlaps(t("intervening_paths"), t("declared_paths"))


@query("prom_1_overlaps", f"""
SELECT a.promotion_id, a.commit_sha, a.changed_path, d.declared_path, d.kind
FROM {{intervening_paths}} a JOIN {{declared_paths}} d ON a.promotion_id = d.promotion_id AND {OVER}
""")
def _(t):
    return _overlaps(t)


def _ladder(relevant: str, reasons: str, prefix: str) -> str:
    return f"""
SELECT {prefix}promotion_id, CASE WHEN conflict THEN 'rerun_required' WHEN NOT mergeable THEN 'rerun_required'
         WHEN tested_change_set <> current_change_set THEN 'rerun_required'
         WHEN tested_merge_tree = current_merge_tree OR tested_base_tree = current_base_tree THEN 'receipt_reusable'
         WHEN {relevant} THEN 'rerun_required' WHEN scope_complete THEN 'receipt_reusable' ELSE 'inspect_semantic_overlap' END AS disposition,
       CASE WHEN conflict THEN 'merge_conflict' WHEN NOT mergeable THEN 'not_mergeable'
         WHEN tested_change_set <> current_change_set THEN 'change_set_changed'
         WHEN tested_merge_tree = current_merge_tree THEN 'exact_effective_merge_tree_identity'
         WHEN tested_base_tree = current_base_tree THEN 'equivalent_change_set_same_base_tree'
         WHEN {relevant} THEN {reasons} WHEN scope_complete THEN 'complete_compatibility_scope_no_relevant_change'
         ELSE 'semantic_independence_unknown' END AS reasons
"""


KINDS = """concat_ws(',', CASE WHEN f.b THEN 'branch_path_overlap' END, CASE WHEN f.c THEN 'consumed_contract_overlap' END,
                     CASE WHEN f.p THEN 'applicable_policy_overlap' END)"""
FLAGS = """promotion_id, bool_or(kind = 'branch_path') AS b, bool_or(kind = 'consumed_contract') AS c, bool_or(kind = 'applicable_policy') AS p"""


@query("prom_2_receipts", f"""
WITH f AS (SELECT {FLAGS} FROM (SELECT a.promotion_id, d.kind FROM {{intervening_paths}} a
           JOIN {{declared_paths}} d ON a.promotion_id = d.promotion_id AND {OVER}) o GROUP BY promotion_id)
{_ladder("f.promotion_id IS NOT NULL", KINDS, "m.")}
FROM {{promotions}} m LEFT JOIN f ON f.promotion_id = m.promotion_id
""")
def _(t):
    rows = op.promotion_receipts(t("promotions"), _overlaps(t))
    return rows.withColumn("reasons", F.array_join("reasons", ","))


adapter("change_entries", """
SELECT CAST(l_orderkey AS STRING) AS change_set_id, concat(path, '.', CAST(l_linenumber AS STRING)) AS path,
       concat('b', CAST(l_suppkey AS STRING)) AS blob_sha
FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
""")


@query("prom_3_change_set_fingerprint", f"""
WITH p AS (SELECT change_set_id, count(DISTINCT path) AS entries, count(*) AS n FROM {{change_entries}} GROUP BY change_set_id),
d AS ({sq.bag("{change_entries}", "change_set_id", sq.digest("path", "blob_sha"), op.CHANGE_SET_VERSION)})
SELECT p.change_set_id, entries, CASE WHEN n = entries THEN concat('sha256:', d.digest) END AS fingerprint
FROM p JOIN d ON d.change_set_id = p.change_set_id
""")
def _(t):
    return op.change_set_fingerprint(t("change_entries"))


adapter("base_ranges", """
SELECT promotion_id, 'tested' AS side, merge_base_sha AS base_sha, tested_base_sha AS head_sha,
       CASE WHEN CAST(promotion_id AS BIGINT) % 19 = 0 THEN 0 ELSE 3 END AS commit_count
FROM {promotions} WHERE merge_base_sha <> 'b1' AND (CAST(promotion_id AS BIGINT) % 23 = 0 OR tested_base_tree <> current_base_tree)
UNION ALL
SELECT promotion_id, 'current' AS side, CASE WHEN CAST(promotion_id AS BIGINT) % 29 = 0 THEN 'bx' ELSE merge_base_sha END AS base_sha,
       current_base_sha AS head_sha, 2 AS commit_count
FROM {promotions} WHERE merge_base_sha <> 'b2' AND tested_base_tree <> current_base_tree AND CAST(promotion_id AS BIGINT) % 31 <> 0
""")
adapter("range_paths", """
SELECT DISTINCT a.promotion_id, r.side, a.changed_path FROM {intervening_paths} a JOIN {base_ranges} r ON r.promotion_id = a.promotion_id
WHERE (r.side = 'tested') = (a.commit_sha = 's0')
""")
adapter("compatibility_objects", """
SELECT DISTINCT promotion_id, kind, declared_path AS path,
       CASE WHEN length(declared_path) % 5 = 0 THEN NULL ELSE concat('x', CAST(length(declared_path) AS STRING)) END AS tested_object,
       CASE WHEN (CAST(promotion_id AS BIGINT) + length(declared_path)) % 9 = 0 THEN 'y'
            WHEN length(declared_path) % 5 = 0 THEN NULL ELSE concat('x', CAST(length(declared_path) AS STRING)) END AS current_object
FROM {declared_paths} WHERE kind <> 'branch_path' AND CAST(promotion_id AS BIGINT) % 15 <> 0
UNION ALL
SELECT promotion_id, kind, concat(declared_path, '/extra') AS path, 'z' AS tested_object, 'z' AS current_object
FROM {declared_paths} WHERE kind = 'applicable_policy' AND CAST(promotion_id AS BIGINT) % 21 = 0
UNION ALL
SELECT promotion_id, kind, declared_path AS path, 'z' AS tested_object, 'z' AS current_object
FROM {declared_paths} WHERE kind = 'consumed_contract' AND CAST(promotion_id AS BIGINT) % 25 = 0
""")
RELATION = """
WITH s AS (
  SELECT p.promotion_id,
    CASE WHEN p.tested_base_tree = p.current_base_tree THEN
           CASE WHEN t.promotion_id IS NOT NULL OR c.promotion_id IS NOT NULL THEN 'equal_trees_with_range' END
         WHEN t.promotion_id IS NULL AND c.promotion_id IS NULL THEN 'changed_trees_without_range'
         WHEN t.base_sha <> p.merge_base_sha OR t.head_sha <> p.tested_base_sha OR t.commit_count < 1
           OR c.base_sha <> p.merge_base_sha OR c.head_sha <> p.current_base_sha OR c.commit_count < 1 THEN 'range_does_not_bind'
         WHEN t.promotion_id IS NULL AND p.merge_base_sha <> p.tested_base_sha THEN 'forward_merge_base'
         WHEN c.promotion_id IS NULL AND p.merge_base_sha <> p.current_base_sha THEN 'rewind_merge_base' END AS rejection,
    CASE WHEN p.tested_base_tree = p.current_base_tree THEN 'same_tree' WHEN t.promotion_id IS NULL THEN 'forward'
         WHEN c.promotion_id IS NULL THEN 'rewind' ELSE 'diverged' END AS shape
  FROM {promotions} p LEFT JOIN {base_ranges} t ON t.promotion_id = p.promotion_id AND t.side = 'tested'
  LEFT JOIN {base_ranges} c ON c.promotion_id = p.promotion_id AND c.side = 'current')
SELECT promotion_id, CASE WHEN rejection IS NOT NULL THEN 'rejected' ELSE shape END AS relation, rejection FROM s
"""


@query("prom_4_base_relation", RELATION)
def _(t):
    return op.base_relation(t("promotions"), t("base_ranges"))


SIDES = f"""SELECT a.promotion_id, a.side, a.changed_path, d.declared_path FROM {{range_paths}} a
  JOIN {{declared_paths}} d ON a.promotion_id = d.promotion_id AND d.kind = 'branch_path' AND {OVER}"""


@query("prom_5_base_overlaps", SIDES)
def _(t):
    return op.base_overlaps(t("range_paths"), t("declared_paths"))


@query("prom_5_base_lineage", f"""
WITH r AS ({RELATION}),
f AS (SELECT {FLAGS} FROM (SELECT promotion_id, 'branch_path' AS kind FROM ({SIDES}) s
        UNION ALL SELECT promotion_id, kind FROM {{compatibility_objects}} WHERE tested_object IS DISTINCT FROM current_object) u GROUP BY promotion_id)
{_ladder("f.promotion_id IS NOT NULL", KINDS, "m.")}, r.relation
FROM {{promotions}} m JOIN r ON r.promotion_id = m.promotion_id AND r.relation <> 'rejected' LEFT JOIN f ON f.promotion_id = m.promotion_id
""")
def _(t):
    relations = op.base_relation(t("promotions"), t("base_ranges"))
    overlaps = op.base_overlaps(t("range_paths"), t("declared_paths"))
    rows = op.base_lineage(t("promotions"), relations, overlaps, t("compatibility_objects"))
    return rows.withColumn("reasons", F.array_join("reasons", ","))


@query("prom_6_compatibility_coverage", """
WITH d AS (SELECT DISTINCT promotion_id, kind, declared_path AS path FROM {declared_paths} WHERE kind <> 'branch_path'),
o AS (SELECT promotion_id, kind, path, count(*) AS n, count(*) FILTER (WHERE tested_object IS NULL AND current_object IS NULL) AS absent
      FROM {compatibility_objects} GROUP BY promotion_id, kind, path)
SELECT d.promotion_id, d.kind, d.path, 'missing_receipt' AS reason FROM d
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.promotion_id = d.promotion_id AND o.kind = d.kind AND o.path = d.path)
UNION ALL
SELECT o.promotion_id, o.kind, o.path,
       CASE WHEN NOT EXISTS (SELECT 1 FROM d WHERE o.promotion_id = d.promotion_id AND o.kind = d.kind AND o.path = d.path) THEN 'unexpected_receipt'
            WHEN n > 1 THEN 'duplicate_receipt' ELSE 'absent_on_both_bases' END AS reason
FROM o WHERE n > 1 OR absent > 0 OR NOT EXISTS (SELECT 1 FROM d WHERE o.promotion_id = d.promotion_id AND o.kind = d.kind AND o.path = d.path)
""")
def _(t):
    return op.compatibility_coverage(t("declared_paths"), t("compatibility_objects"))
