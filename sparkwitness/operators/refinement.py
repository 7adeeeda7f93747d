"""Cohort refinement: does splitting by one more fact lower the counterexample rate?

``observations(cohort_id, outcome, facts map<string,string>)``,
``discriminators(cohort_id, discriminator)``, ``current(cohort_id, facts)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = ["retained", "weakened", "split"]


def _outcomes(prefix: str):
    return [
        F.count_if(F.col("outcome") == "support").alias(f"{prefix}support"),
        F.count_if(F.col("outcome") == "counterexample").alias(f"{prefix}counterexamples"),
    ]


def cohort_partitions(observations: DataFrame, discriminators: DataFrame) -> DataFrame:
    """Counts per discriminator value; observations without the fact form the null partition.

    Facts are exploded and counted map-side, and the null partition is baseline minus the rest,
    so no observation is repeated per discriminator.
    """
    baseline = observations.groupBy("cohort_id").agg(*_outcomes("baseline_"))
    known = (
        observations.select("cohort_id", "outcome", F.explode("facts").alias("discriminator", "value"))
        .where("value IS NOT NULL")
        .groupBy("cohort_id", "discriminator", "value")
        .agg(*_outcomes(""))
    )
    wanted = discriminators.select("cohort_id", "discriminator").distinct()
    asked = known.join(wanted, ["cohort_id", "discriminator"], "left_semi")
    present = asked.groupBy("cohort_id", "discriminator").agg(
        F.sum("support").alias("_s"), F.sum("counterexamples").alias("_c")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    missing = (
        wanted.join(baseline, "cohort_id")
        .join(present, ["cohort_id", "discriminator"], "left")
        .select(
            "cohort_id", "discriminator", F.lit(None).cast("string").alias("value"),
            (F.col("baseline_support") - zero("_s")).alias("support"),
            (F.col("baseline_counterexamples") - zero("_c")).alias("counterexamples"),
        )
        .where("support + counterexamples > 0")
    )
    return asked.unionByName(missing).join(baseline, "cohort_id")


def evaluate_refinements(
    observations: DataFrame, discriminators: DataFrame, current: DataFrame, min_support: int
) -> DataFrame:
    """unknown_current / incomplete_evidence / no_improvement / overfit / candidate."""
    partitions = cohort_partitions(observations, discriminators)
    key = ["cohort_id", "discriminator"]
    counts = ["support", "counterexamples"]
    asked = discriminators.select(*key).distinct().join(current, "cohort_id", "left").select(
        *key, F.try_element_at("facts", F.col("discriminator")).alias("current_value")
    )
    own = partitions.where("value IS NOT NULL").select(*key, F.col("value").alias("current_value"), *counts)
    gaps = partitions.where("value IS NULL").select(*key, F.col("counterexamples").alias("_gaps"))
    baseline = observations.groupBy("cohort_id").agg(*_outcomes("baseline_"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    improves = (
        wide("counterexamples") * (wide("baseline_support") + wide("baseline_counterexamples")).cast("decimal(19,0)")
        < wide("baseline_counterexamples") * (wide("support") + wide("counterexamples")).cast("decimal(19,0)")
    )
    excluded = F.col("baseline_counterexamples") - F.col("counterexamples")
    status = (
        F.when(F.col("support").isNull(), "unknown_current")
        .when(F.coalesce("_gaps", F.lit(0)) > 0, "incomplete_evidence")
        .when(excluded == 0, "no_improvement")
        .when(F.col("support") < min_support, "overfit")
        .when(~improves, "no_improvement")
        .otherwise("candidate")
    )
    return (
        asked.join(own, [*key, "current_value"], "left")
        .join(gaps, key, "left")
        .join(baseline, "cohort_id", "left")
        .select(
            *key, "current_value", status.alias("status"), *counts,
            "baseline_support", "baseline_counterexamples",
            (F.col("baseline_support") - F.col("support")).alias("excluded_support"),
            excluded.alias("excluded_counterexamples"),
        )
    )


def refinement_violations(episodes: DataFrame) -> DataFrame:
    """Inconsistent candidates and selections.

    ``episodes(episode_id, admitted array<string>, selected_transition, candidates
    array<struct<id, discriminators array<string>, status, resolved, lost, held_out>>)``
    """
    item = episodes.select("episode_id", "admitted", "selected_transition", F.explode("candidates").alias("c"))
    kept = F.col("c.status").isin(*KEPT)
    checks = [
        ("unadmitted_discriminator", F.size(F.array_except("c.discriminators", "admitted")) > 0),
        ("kept_loses_expected", kept & (F.col("c.lost") != 0)),
        ("kept_resolves_nothing", kept & (F.col("c.resolved") == 0)),
        ("kept_failed_held_out", kept & (F.col("c.held_out") == "failed")),
        (
            "no_improvement_changes_replay",
            (F.col("c.status") == "rejected_no_improvement") & ((F.col("c.resolved") != 0) | (F.col("c.lost") != 0)),
        ),
        ("lost_case_loses_nothing", (F.col("c.status") == "rejected_lost_expected_case") & (F.col("c.lost") == 0)),
        ("selected_not_kept", (F.col("c.id") == F.col("selected_transition")) & ~kept),
    ]
    reasons = F.array_compact(F.array(*[F.when(test, name) for name, test in checks]))
    per_candidate = item.select("episode_id", F.col("c.id").alias("candidate_id"), F.explode(reasons).alias("reason"))
    absent = episodes.where(
        F.col("selected_transition").isNotNull()
        & ~F.exists("candidates", lambda c: c["id"] == F.col("selected_transition"))
    ).select(
        "episode_id", F.col("selected_transition").alias("candidate_id"), F.lit("selected_absent").alias("reason")
    )
    return per_candidate.unionByName(absent)
