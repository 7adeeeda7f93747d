"""Admission of unmerged branches that no open pull request stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_LIMIT = 20


def admit_branches(
    refs: DataFrame,
    open_heads: DataFrame,
    provider_refs: DataFrame,
    associated: DataFrame,
    limit: int = CANDIDATE_LIMIT,
) -> DataFrame:
    """Decision for the newest ``limit`` candidate branches of each repository.

    ``refs(repository, branch, sha, committed_at)``, ``open_heads(repository, branch)``,
    ``provider_refs(repository, branch, provider_sha, truncated)`` with a null ``truncated`` when the
    association was not returned, ``associated(repository, provider_sha, branch, state)``.
    """
    newest = Window.partitionBy("repository").orderBy(F.desc("committed_at"), F.desc("branch"))
    candidates = (
        refs.join(open_heads, ["repository", "branch"], "left_anti")
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )
    exact = associated.groupBy("repository", "provider_sha", "branch").agg(
        F.bool_or(F.col("state") == "OPEN").alias("_open"),
        F.bool_or(F.col("state").isin("CLOSED", "MERGED")).alias("_retired"),
    )
    decision = (
        F.when(F.col("provider_sha").isNull(), "provider_ref_missing")
        .when(F.col("provider_sha") != F.col("sha"), "provider_head_mismatch")
        .when(F.col("truncated").isNull(), "association_truncated_unknown")
        .when(F.col("_open"), "provider_open_pr_race")
        .when(F.col("_retired"), "retired_exact_branch_head")
        .when(F.col("truncated"), "association_truncated_unknown")
        .otherwise("admitted")
    )
    return (
        candidates.join(provider_refs, ["repository", "branch"], "left")
        .join(exact, ["repository", "provider_sha", "branch"], "left")
        .select("repository", "branch", "sha", decision.alias("decision"))
    )


def branch_inventory(refs: DataFrame, open_heads: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Per repository of ``refs``: candidate branches, those within ``limit``, and those it leaves out."""
    heads = open_heads.select("repository", "branch").distinct().withColumn("_open", F.lit(True))
    candidates = F.count_if(F.col("_open").isNull())
    counted = refs.join(heads, ["repository", "branch"], "left").groupBy("repository").agg(candidates.alias("candidates"))
    selected = F.least(F.col("candidates"), F.lit(limit).cast("long"))
    return counted.select("repository", "candidates", selected.alias("selected"), (F.col("candidates") - selected).alias("omitted"))


def branch_receipts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("repository", "decision").agg(F.count(F.lit(1)).alias("branches"))
