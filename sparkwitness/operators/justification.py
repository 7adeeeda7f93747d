"""Claims and obligations justified by evidence edges.

``edges(context_set, evidence_id, target_kind, target_id, relation)``; node tables carry
``context_set`` as the graph key.  Receipts stay one row per evidence, so that a claim with very
many edges is never gathered into one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIM_RELATIONS = ["support", "counterexample", "limit", "dependency"]
EDGE = ["context_set", "evidence_id", "target_kind", "target_id", "relation"]


def relation_receipts(edges: DataFrame, statuses: DataFrame) -> DataFrame:
    """Evidence of each target and relation with its status per context."""
    return edges.join(statuses, ["context_set", "evidence_id"]).select(
        "context_set", "context_id", "target_kind", "target_id", "relation", "status", "evidence_id"
    )


def receipt_counts(receipts: DataFrame) -> DataFrame:
    counted = lambda s: F.count_if(F.col("status") == s).alias(s)
    return receipts.groupBy("context_set", "context_id", "target_kind", "target_id", "relation").agg(
        counted("applies"), counted("invalid"), counted("unknown")
    )


def _in_contexts(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    return nodes.join(contexts.select("context_set", "context_id"), "context_set")


def claim_status(claims: DataFrame, contexts: DataFrame, receipts: DataFrame) -> DataFrame:
    """Supported iff some support applies and no dependency is invalid or unknown.

    Counterexamples are reported and never cancel support.
    """
    is_relation = lambda r: F.col("relation") == r
    per_claim = (
        receipts.where(F.col("target_kind") == "claim")
        .groupBy("context_set", "context_id", F.col("target_id").alias("claim_id"))
        .agg(
            F.count_if(is_relation("support") & (F.col("status") == "applies")).alias("_support"),
            F.count_if(is_relation("dependency") & (F.col("status") != "applies")).alias("_blocked"),
            F.count_if(is_relation("counterexample")).alias("_counter"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return (
        _in_contexts(claims, contexts)
        .join(per_claim, ["context_set", "context_id", "claim_id"], "left")
        .select(
            "context_set", "context_id", "claim_id",
            F.when((zero("_support") > 0) & (zero("_blocked") == 0), "supported")
            .otherwise("unknown").alias("status"),
            zero("_support").alias("applying_support"),
            zero("_blocked").alias("blocking_dependencies"),
            zero("_counter").alias("counterexamples"),
        )
    )


def obligation_status(obligations: DataFrame, contexts: DataFrame, receipts: DataFrame) -> DataFrame:
    """Cleared if any clearing evidence applies, else unknown if any is unknown, else open."""
    per_obligation = (
        receipts.where((F.col("target_kind") == "obligation") & (F.col("relation") == "clearing"))
        .groupBy("context_set", "context_id", F.col("target_id").alias("obligation_id"))
        .agg(
            F.bool_or(F.col("status") == "applies").alias("_applies"),
            F.bool_or(F.col("status") == "unknown").alias("_unknown"),
        )
    )
    return (
        _in_contexts(obligations, contexts)
        .join(per_obligation, ["context_set", "context_id", "obligation_id"], "left")
        .select(
            "context_set", "context_id", "obligation_id",
            F.when(F.col("_applies"), "cleared").when(F.col("_unknown"), "unknown").otherwise("open").alias("status"),
        )
    )


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Evidence whose status differs between two evaluations."""
    old = before.select("context_set", "evidence_id", F.col("status").alias("before"))
    new = after.select("context_set", "evidence_id", F.col("status").alias("after"))
    return old.join(new, ["context_set", "evidence_id"]).where(F.col("before") != F.col("after"))


def affected_targets(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Only the targets downstream of evidence that changed."""
    return (
        edges.join(changed, ["context_set", "evidence_id"], "left_semi")
        .select("context_set", "target_kind", "target_id")
        .distinct()
    )


def graph_violations(evidence: DataFrame, claims: DataFrame, obligations: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that keep a graph from being admitted, with the reason."""
    targets = claims.select(
        "context_set", F.lit("claim").alias("target_kind"), F.col("claim_id").alias("target_id")
    ).unionByName(
        obligations.select(
            "context_set", F.lit("obligation").alias("target_kind"), F.col("obligation_id").alias("target_id")
        )
    )
    known = evidence.select("context_set", "evidence_id")
    labelled = lambda df, reason: df.select(*EDGE, F.lit(reason).alias("reason"))
    unknown_evidence = labelled(edges.join(known, ["context_set", "evidence_id"], "left_anti"), "unknown_evidence")
    unknown_target = labelled(
        edges.join(targets, ["context_set", "target_kind", "target_id"], "left_anti"), "unknown_target"
    )
    clears = F.col("relation") == "clearing"
    wrong_relation = labelled(
        edges.where(clears != (F.col("target_kind") == "obligation")), "wrong_relation"
    )
    duplicate = labelled(
        edges.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "duplicate_edge"
    )
    supports = edges.where((F.col("target_kind") == "claim") & (F.col("relation") == "support"))
    bare = claims.join(
        supports.select("context_set", F.col("target_id").alias("claim_id")), ["context_set", "claim_id"], "left_anti"
    ).select(
        "context_set",
        F.lit(None).cast("string").alias("evidence_id"),
        F.lit("claim").alias("target_kind"),
        F.col("claim_id").alias("target_id"),
        F.lit(None).cast("string").alias("relation"),
        F.lit("claim_without_support").alias("reason"),
    )
    parts = [unknown_evidence, unknown_target, wrong_relation, duplicate, bare]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
