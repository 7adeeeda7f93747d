"""One front over six families of prior episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The only status of each family that leads to an action, and that action.
FINAL = {
    "issue_closure": ("inspect_prior_failure", "inspect_prior_failure_and_rereport"),
    "lesson_promotion": ("observed_promotion", "use_accepted_guard"),
    "proxy_revision": ("observed_proxy_revision", "use_corrected_predicate"),
    "observation_reconciliation": ("observed_reconciliation", "await_bounded_convergence"),
    "proof_surface": ("observed_proof_surface_mismatch", "produce_required_proof_artifact"),
}
REVIEW_ACTIONS = {
    "reuse_current_thread": "reuse_existing_review_thread",
    "refresh_existing_thread": "recompute_and_refresh_review_thread",
    "need_context": "acquire_missing_review_coordinate",
}


def episode_front(dispositions: DataFrame, claims: DataFrame) -> DataFrame:
    """Every input with its lane: ``item`` (next action), ``quiet`` (reason), ``rejected``.

    ``dispositions(id, status, matches)`` are review dispositions; ``claims(id, family, status)`` are those of the other families.
    """
    has_lineage = F.col("matches") > 0
    action = F.coalesce(*[F.when(F.col("status") == s, F.lit(a)) for s, a in REVIEW_ACTIONS.items()])
    acts = F.col("status").isin("reuse_current_thread", "refresh_existing_thread") | (
        (F.col("status") == "need_context") & has_lineage
    )
    review = dispositions.select(
        "id", F.lit("review").alias("family"), "status",
        F.when(acts, "item").otherwise("quiet").alias("lane"),
        F.when(acts, action)
        .when(has_lineage, "no_current_review_lineage")
        .otherwise("no_prior_review_lineage").alias("next"),
    )
    then = F.coalesce(*[F.when((F.col("family") == f) & (F.col("status") == s), F.lit(a)) for f, (s, a) in FINAL.items()])
    rest = claims.select(
        "id", "family", "status", F.when(then.isNotNull(), "item").otherwise("rejected").alias("lane"), then.alias("next"))
    return review.unionByName(rest)


def episode_detail(front: DataFrame, claims: DataFrame, repairs: DataFrame) -> DataFrame:
    """Accepted guard behind each selected lesson item; one row per repair it rests on."""
    chosen = front.where((F.col("family") == "lesson_promotion") & (F.col("lane") == "item")).select(
        F.col("id").alias("claim_id"), "next"
    )
    return (
        claims.join(chosen, "claim_id")
        .join(repairs.select("claim_id", F.col("number").alias("repair")).distinct(), "claim_id")
        .select(
            "claim_id", "next", "discriminator", "value_ref", "repair_marker", "guard", "guard_marker",
            "guard_evidence", "enforcement_kind", "enforcement_path", "scope_ref", "repair",
        )
    )
