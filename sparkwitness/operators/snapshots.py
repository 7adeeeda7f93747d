"""Identities of work snapshots, and keyed deltas on findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import bag_digest, digest

WORK_FACT_VERSION = "work-fact/1"
SELECTION_VERSION = "selection/1"
SNAPSHOT_VERSION = "snapshot/1"
FINDINGS_VERSION = "findings/1"


def work_fact_identity(work_items: DataFrame, work_paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Identity per snapshot: work, path sets and semantic edges.

    Row order, case of the head and the source of an edge do not matter; paths, activity and
    edge direction do.
    """
    key = ["snapshot_id", "id"]
    paths = bag_digest(work_paths.select(*key, "path").distinct(), key, F.sha2("path", 256), "paths/1", "_paths").drop("members")
    item = digest(F.col("id"), F.lower("head_sha"), F.col("activity"), F.col("_paths"))
    work = bag_digest(work_items.join(paths, key, "left"), ["snapshot_id"], item, "work/1", "_work").drop("members")
    semantic = edges.select("snapshot_id", "kind", "from_id", "to_id").distinct()
    links = bag_digest(semantic, ["snapshot_id"], digest(F.col("kind"), F.col("from_id"), F.col("to_id")), "edges/1", "_edges").drop("members")
    return work.join(links, "snapshot_id", "left").select(
        "snapshot_id", digest(F.lit(WORK_FACT_VERSION), F.col("_work"), F.col("_edges")).alias("work_fact_identity")
    )


def selection_identity(selections: DataFrame) -> DataFrame:
    """Identity of what was asked of a provider; the page size is transport and left out.

    ``selections(selection_id, provider_kind, provider_instance, collection, work_kind, states array,
    draft_policy, max_items, order_field, order_direction, tie_break)``: a null ``max_items`` means
    exhaustive, which makes the order irrelevant.
    """
    bounded = F.col("max_items").isNotNull()
    only = lambda c: F.when(bounded, F.col(c).cast("string"))
    rejection = (
        F.when(F.size("states") < 1, "no_state")
        .when(F.size(F.array_distinct("states")) != F.size("states"), "duplicate_state")
        .when(F.col("max_items") < 1, "empty_bound")
        .when(bounded & F.col("tie_break").isNull(), "bounded_without_tie_break")
        .when(~bounded & F.col("tie_break").isNotNull(), "exhaustive_with_tie_break")
    )
    identity = digest(
        F.lit(SELECTION_VERSION), F.col("provider_kind"), F.lower("provider_instance"), F.lower("collection"),
        F.col("work_kind"), F.array_join(F.array_sort("states"), ","), F.col("draft_policy"),
        only("max_items"), only("order_field"), only("order_direction"), only("tie_break"),
    )
    return selections.withColumn("rejection", rejection).select(
        "selection_id", F.when(F.col("rejection").isNull(), identity).alias("selection_identity"), "rejection"
    )


def snapshot_identity(selections: DataFrame, work_facts: DataFrame, composed: DataFrame) -> DataFrame:
    """``composed(selection_id, snapshot_id)``; unknown when either part is unknown."""
    both = F.col("selection_identity").isNotNull() & F.col("work_fact_identity").isNotNull()
    identity = F.concat(
        F.lit("sha256:"), digest(F.lit(SNAPSHOT_VERSION), F.col("selection_identity"), F.col("work_fact_identity"))
    )
    return (
        composed.join(selections, "selection_id", "left")
        .join(work_facts, "snapshot_id", "left")
        .select("selection_id", "snapshot_id", F.when(both, identity).alias("snapshot_identity"))
    )


def findings_fingerprint(findings: DataFrame) -> DataFrame:
    """Identity of the ordered findings of a snapshot: ``position`` is part of each member."""
    member = digest(
        F.col("position"), F.col("kind"), F.col("target"), F.col("message"), F.col("resolved").cast("string")
    )
    return bag_digest(findings, ["snapshot_id"], member, FINDINGS_VERSION, "fingerprint").drop("members")


def delta_receipts(findings: DataFrame, deltas: DataFrame) -> DataFrame:
    """applied / base_mismatch / missing_target per ``deltas(snapshot_id, kind, target, base)``.

    A null ``base`` skips the base check.
    """
    targets = findings.select("snapshot_id", "kind", "target").distinct().withColumn("_found", F.lit(True))
    status = (
        F.when(F.col("base").isNotNull() & ~F.col("base").eqNullSafe(F.col("fingerprint")), "base_mismatch")
        .when(F.col("_found").isNull(), "missing_target")
        .otherwise("applied")
    )
    return (
        deltas.join(findings_fingerprint(findings), "snapshot_id", "left")
        .join(targets, ["snapshot_id", "kind", "target"], "left")
        .select("snapshot_id", "kind", "target", status.alias("status"))
    )


def apply_deltas(findings: DataFrame, deltas: DataFrame) -> DataFrame:
    """Findings with the first row of each applied key resolved."""
    applied = (
        delta_receipts(findings, deltas).where(F.col("status") == "applied")
        .select("snapshot_id", "kind", "target").distinct().withColumn("_applied", F.lit(True))
    )
    first = findings.groupBy("snapshot_id", "kind", "target").agg(F.min("position").alias("_first"))
    key = ["snapshot_id", "kind", "target"]
    hit = F.col("_applied").isNotNull() & (F.col("position") == F.col("_first"))
    return (
        findings.join(applied, key, "left").join(first, key)
        .select("snapshot_id", "position", "kind", "target", "message", (F.col("resolved") | hit).alias("resolved"))
    )
