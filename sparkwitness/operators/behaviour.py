"""Receipts of what delivered evidence did to the next action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Outcomes that need, or forbid, a recorded action.
ACTION_REQUIRED = [
    "changed_next_action", "prevented_or_reversed_wrong_turn", "stale_or_wrong_coordinate", "needed_stronger_evidence",
]
ACTION_FORBIDDEN = ["useful_same_action", "irrelevant"]
QUIET_OUTCOME = "correct_quiet_negative"


def receipt_violations(receipts: DataFrame) -> DataFrame:
    """First broken rule of ``receipts(episode_id, delivery, consulted, outcome, action)``."""
    quiet = F.col("delivery") == "quiet"
    outcome, acted = F.col("outcome"), F.col("action").isNotNull()
    ignored = outcome == "ignored"
    reason = (
        F.when(quiet & F.col("consulted"), "quiet_consulted")
        .when(quiet & (outcome != QUIET_OUTCOME), "quiet_outcome")
        .when(quiet & acted, "quiet_action")
        .when(quiet, None)
        .when(outcome == QUIET_OUTCOME, "surfaced_quiet_outcome")
        .when(ignored & F.col("consulted"), "ignored_consulted")
        .when(ignored & acted, "ignored_action")
        .when(ignored, None)
        .when(~F.col("consulted"), "outcome_needs_consultation")
        .when(outcome.isin(ACTION_REQUIRED) & ~acted, "outcome_needs_action")
        .when(outcome.isin(ACTION_FORBIDDEN) & acted, "outcome_forbids_action")
    )
    return receipts.select("episode_id", "delivery", "outcome", reason.alias("reason")).where("reason IS NOT NULL")


def behavior_summary(receipts: DataFrame) -> DataFrame:
    """Totals, counts by outcome and counts by evidence kind, from one pass over the rows.

    Ids behind a count stay in :func:`behavior_members`: a count may stand for any number.
    """
    sets = receipts.groupingSets(
        [[F.col("outcome")], [F.col("evidence_kind")], []], F.col("outcome"), F.col("evidence_kind")
    ).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(F.col("delivery") == "surfaced").alias("surfaced"),
        F.count_if(F.col("delivery") == "quiet").alias("quiet"),
        F.count_if(F.col("consulted")).alias("consulted"),
    )
    grouping = (
        F.when(F.col("_set") == 1, "outcome").when(F.col("_set") == 2, "evidence_kind").otherwise("total")
    )
    return sets.select(
        grouping.alias("grouping"), F.coalesce("outcome", "evidence_kind").alias("key"),
        "episodes", "surfaced", "quiet", "consulted",
    )


def behavior_members(receipts: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.lit("outcome").alias("grouping"), F.col("outcome").alias("key")),
        F.struct(F.lit("evidence_kind").alias("grouping"), F.col("evidence_kind").alias("key")),
    )
    return receipts.select(F.inline(both), "episode_id")
