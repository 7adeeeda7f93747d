"""May a receipt earned on an earlier base still be used?

``promotions`` holds one row per promotion with the tested and current coordinates; declared paths,
intervening paths, base ranges and compatibility objects are child tables keyed by
``promotion_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import bag_digest, digest
from ..plans.scopes import overlap_join

# Kinds of declared path, and the reason an overlap of each kind gives.
OVERLAP_REASONS = {
    "branch_path": "branch_path_overlap",
    "consumed_contract": "consumed_contract_overlap",
    "applicable_policy": "applicable_policy_overlap",
}
CHANGE_SET_VERSION = "change-set/1"


def promotion_overlaps(intervening_paths: DataFrame, declared_paths: DataFrame) -> DataFrame:
    """Intervening paths that cover, or lie below, a declared path.

    ``intervening_paths(promotion_id, commit_sha, changed_path)``,
    ``declared_paths(promotion_id, kind, declared_path)``.
    """
    left = intervening_paths.select("promotion_id", "commit_sha", "changed_path")
    right = declared_paths.select("promotion_id", "kind", "declared_path")
    return overlap_join(left, right, ["promotion_id"], "changed_path", "declared_path").select(
        "promotion_id", "commit_sha", "changed_path", "declared_path", "kind"
    ).distinct()


def _decide(relevant: Column, overlap_reasons: Column) -> tuple[Column, Column]:
    """Disposition and reasons; the order of the branches is part of the contract."""
    one = lambda r: F.array(F.lit(r))
    reason = (
        F.when(F.col("conflict"), one("merge_conflict"))
        .when(~F.col("mergeable"), one("not_mergeable"))
        .when(F.col("tested_change_set") != F.col("current_change_set"), one("change_set_changed"))
        .when(F.col("tested_merge_tree") == F.col("current_merge_tree"), one("exact_effective_merge_tree_identity"))
        .when(F.col("tested_base_tree") == F.col("current_base_tree"), one("equivalent_change_set_same_base_tree"))
        .when(relevant, overlap_reasons)
        .when(F.col("scope_complete"), one("complete_compatibility_scope_no_relevant_change"))
        .otherwise(one("semantic_independence_unknown"))
    )
    first = reason[0]
    disposition = (
        F.when(
            first.isin(
                "exact_effective_merge_tree_identity",
                "equivalent_change_set_same_base_tree",
                "complete_compatibility_scope_no_relevant_change",
            ),
            "receipt_reusable",
        )
        .when(first == "semantic_independence_unknown", "inspect_semantic_overlap")
        .otherwise("rerun_required")
    )
    return disposition, reason


def _flags(rows: DataFrame, kinds) -> DataFrame:
    return rows.groupBy("promotion_id").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in kinds]
    )


def _reason_array() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"_{k}"), r) for k, r in OVERLAP_REASONS.items()]))


def promotion_receipts(promotions: DataFrame, overlaps: DataFrame) -> DataFrame:
    """rerun_required / receipt_reusable / inspect_semantic_overlap with every reason."""
    relevant = F.coalesce(*[F.when(F.col(f"_{k}"), True) for k in OVERLAP_REASONS], F.lit(False))
    disposition, reasons = _decide(relevant, _reason_array())
    return promotions.join(_flags(overlaps, OVERLAP_REASONS), "promotion_id", "left").select(
        "promotion_id", disposition.alias("disposition"), reasons.alias("reasons")
    )


def change_set_fingerprint(entries: DataFrame) -> DataFrame:
    """Order-free identity of ``entries(change_set_id, path, blob_sha)``.

    Equal sets agree, any changed, added or removed entry differs; a change set with a repeated
    path is rejected.  The identity is the root of a digest tree, so a huge change set is never gathered.
    """
    n, paths = F.count(F.lit(1)), F.count_distinct("path")
    counts = entries.groupBy("change_set_id").agg(paths.alias("entries"), (n == paths).alias("_once"))
    members = bag_digest(entries, ["change_set_id"], digest(F.col("path"), F.col("blob_sha")), CHANGE_SET_VERSION, "_digest", mostly_small=True)
    return counts.join(members, "change_set_id").select(
        "change_set_id", "entries", F.when(F.col("_once"), F.concat(F.lit("sha256:"), "_digest")).alias("fingerprint")
    )


def base_relation(promotions: DataFrame, ranges: DataFrame) -> DataFrame:
    """same_tree / forward / rewind / diverged, or ``rejected`` with the reason.

    ``ranges(promotion_id, side, base_sha, head_sha, commit_count)``; side is ``tested`` or
    ``current``: the commits only that base has since the merge base.
    """
    side = lambda s: ranges.where(F.col("side") == s).select(
        "promotion_id",
        F.struct("base_sha", "head_sha", "commit_count").alias(f"_{s}"),
    )
    tested, current = F.col("_tested"), F.col("_current")
    bad = lambda r, head: r.isNotNull() & (
        (r["base_sha"] != F.col("merge_base_sha")) | (r["head_sha"] != head) | (r["commit_count"] < 1)
    )
    same = F.col("tested_base_tree") == F.col("current_base_tree")
    rejection = (
        F.when(same & (tested.isNotNull() | current.isNotNull()), "equal_trees_with_range")
        .when(same, None)
        .when(tested.isNull() & current.isNull(), "changed_trees_without_range")
        .when(bad(tested, F.col("tested_base_sha")) | bad(current, F.col("current_base_sha")), "range_does_not_bind")
        .when(tested.isNull() & (F.col("merge_base_sha") != F.col("tested_base_sha")), "forward_merge_base")
        .when(current.isNull() & (F.col("merge_base_sha") != F.col("current_base_sha")), "rewind_merge_base")
    )
    relation = (
        F.when(F.col("rejection").isNotNull(), "rejected")
        .when(same, "same_tree")
        .when(tested.isNull(), "forward")
        .when(current.isNull(), "rewind")
        .otherwise("diverged")
    )
    return (
        promotions.join(side("tested"), "promotion_id", "left")
        .join(side("current"), "promotion_id", "left")
        .withColumn("rejection", rejection)
        .select("promotion_id", relation.alias("relation"), "rejection")
    )


def base_overlaps(range_paths: DataFrame, declared_paths: DataFrame) -> DataFrame:
    """Branch paths touched on either side; ``range_paths(promotion_id, side, changed_path)``."""
    branch = declared_paths.where(F.col("kind") == "branch_path").select("promotion_id", "declared_path")
    return overlap_join(
        range_paths.select("promotion_id", "side", "changed_path"), branch, ["promotion_id"], "changed_path", "declared_path"
    ).select("promotion_id", "side", "changed_path", "declared_path").distinct()


def changed_objects(objects: DataFrame) -> DataFrame:
    """Compatibility objects that differ between the bases; absence on one side is a change."""
    return objects.where(~F.col("tested_object").eqNullSafe(F.col("current_object")))


def base_lineage(promotions: DataFrame, relations: DataFrame, overlaps: DataFrame, objects: DataFrame) -> DataFrame:
    """Disposition per promotion whose base relation was admitted."""
    hits = overlaps.select("promotion_id", F.lit("branch_path").alias("kind")).unionByName(
        changed_objects(objects).select("promotion_id", "kind")
    )
    relevant = F.coalesce(*[F.when(F.col(f"_{k}"), True) for k in OVERLAP_REASONS], F.lit(False))
    disposition, reasons = _decide(relevant, _reason_array())
    return (
        promotions.join(relations.where(F.col("relation") != "rejected"), "promotion_id")
        .join(_flags(hits, OVERLAP_REASONS), "promotion_id", "left")
        .select("promotion_id", "relation", disposition.alias("disposition"), reasons.alias("reasons"))
    )


def compatibility_coverage(declared_paths: DataFrame, objects: DataFrame) -> DataFrame:
    """Declared contract and policy paths without object receipt, unexpected or duplicate receipts,
    and receipts absent on both bases."""
    key = ["promotion_id", "kind", "path"]
    declared = (
        declared_paths.where(F.col("kind") != "branch_path")
        .select("promotion_id", "kind", F.col("declared_path").alias("path"), F.lit(True).alias("_declared"))
        .distinct()
    )
    seen = objects.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(F.col("tested_object").isNull() & F.col("current_object").isNull()).alias("_absent"),
    )
    reason = (
        F.when(F.col("_n").isNull(), "missing_receipt")
        .when(F.col("_declared").isNull(), "unexpected_receipt")
        .when(F.col("_n") > 1, "duplicate_receipt")
        .when(F.col("_absent"), "absent_on_both_bases")
    )
    return declared.join(seen, key, "full").select(*key, reason.alias("reason")).where("reason IS NOT NULL")
