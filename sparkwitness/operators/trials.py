"""Paired trials: fingerprints, pairing, admission, retirement of a demand, failure boundaries.

A pair is two runs.  All comparisons of a pair are ``min``/``max`` over its group, so a pair id that
by mistake repeats very often is still combined map-side and reported, never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest

PLAN_VERSION = "trial-plan/1"
PACKET_VERSION = "trial-packet/1"
CONTEXT_VERSION = "trial-context/1"

FROZEN = [
    "trial_id", "trial_spec", "repository", "revision", "target_path", "target_blob", "task", "patch",
    "completion_contract", "worker_identity", "harness_identity", "affordance_identity", "sampling_config",
]


def trial_fingerprints(plans: DataFrame) -> DataFrame:
    """Identities of the plan, of both contexts and of both worker packets.

    ``plans(trial_id, task_instruction, actions array<struct<id,label>>, control_context,
    treatment_context)``; the arms are part of the plan, the arm name is not part of a packet.
    """
    actions = F.array_join(
        F.transform("actions", lambda a: digest(a["id"], a["label"])), ","
    )
    context = lambda c: digest(F.lit(CONTEXT_VERSION), F.col(c))
    plan = digest(
        F.lit(PLAN_VERSION), F.col("trial_id"), F.col("task_instruction"), F.size("actions"), actions,
        context("control_context"), context("treatment_context"),
    )
    packet = lambda c: digest(
        F.lit(PACKET_VERSION), F.col("plan_fingerprint"), F.col("task_instruction"), actions, F.col(c), context(c)
    )
    return plans.withColumn("plan_fingerprint", plan).select(
        "trial_id", "plan_fingerprint",
        context("control_context").alias("control_context_digest"),
        context("treatment_context").alias("treatment_context_digest"),
        packet("control_context").alias("control_packet"),
        packet("treatment_context").alias("treatment_packet"),
    )


def trial_pairs(fingerprints: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations mapped to arms by packet: evaluated, or why not.

    ``observations(trial_id, packet_fingerprint, first_action)``.
    """
    packet = F.col("packet_fingerprint")
    arm = F.when(packet == F.col("control_packet"), "control").when(packet == F.col("treatment_packet"), "treatment")
    # Equal observations are counted before the join, so a repeated packet stays one row.
    seen = observations.groupBy("trial_id", "packet_fingerprint").agg(
        F.count(F.lit(1)).alias("_n"), F.max("first_action").alias("_action")
    )
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))
    action = lambda a: F.max(F.when(F.col("_arm") == a, F.col("_action")))
    rows = (
        fingerprints.join(seen, "trial_id", "left")
        .withColumn("_arm", arm)
        .groupBy("trial_id")
        .agg(
            of(F.col("_arm") == "control").alias("_c"), of(F.col("_arm") == "treatment").alias("_t"),
            of(packet.isNotNull() & F.col("_arm").isNull()).alias("_unknown"),
            action("control").alias("control_action"), action("treatment").alias("treatment_action"),
        )
    )
    status = (
        F.when(F.col("_unknown") > 0, "unknown_packet")
        .when((F.col("_c") > 1) | (F.col("_t") > 1), "duplicate_arm")
        .when(F.col("_c") == 0, "missing_control")
        .when(F.col("_t") == 0, "missing_treatment")
        .otherwise("evaluated")
    )
    done = F.col("status") == "evaluated"
    return rows.withColumn("status", status).select(
        "trial_id", "status",
        F.when(done, F.col("control_action")).alias("control_action"),
        F.when(done, F.col("treatment_action")).alias("treatment_action"),
        F.when(done, F.col("control_action") == F.col("treatment_action")).alias("same_first_action"),
    )


def _drift(c: str) -> Column:
    return F.min(c) != F.max(c)


def _reused(c: str) -> Column:
    return F.min(c) == F.max(c)


def pair_admission(runs: DataFrame) -> DataFrame:
    """admitted / confounded / invalid_pair with every confound; other group sizes are rejected."""
    flags = {
        "same_arm": _reused("arm"),
        "worker_identity_drift": _drift("worker_identity"),
        "harness_identity_drift": _drift("harness_identity"),
        "affordance_identity_drift": _drift("affordance_identity"),
        "sampling_config_drift": _drift("sampling_config"),
        "non_fresh_session": ~F.bool_and("fresh_session"),
        "prior_condition_exposure": F.bool_or("prior_condition_exposure"),
        "reused_session_id": _reused("session_id"),
        "reused_freshness_receipt": _reused("freshness_receipt"),
        "reused_worker_ref": _reused("worker_ref"),
        "invalid_sequence_coverage": (F.min("sequence_index") != 1) | (F.max("sequence_index") != 2),
    }
    grouped = runs.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("runs"), *[f.alias(name) for name, f in flags.items()]
    )
    identity = [n for n in flags if n.endswith("_drift")]
    sessions = [n for n in flags if n not in identity and n != "same_arm"]
    none_of = lambda names: ~reduce(lambda a, b: a | b, [F.col(n) for n in names])
    reasons = F.array_compact(F.array(*[F.when(F.col(n), n) for n in flags]))
    verdict = (
        F.when(F.col("runs") != 2, "rejected")
        .when(F.col("same_arm"), "invalid_pair")
        .when(F.size(reasons) == 0, "admitted")
        .otherwise("confounded")
    )
    return grouped.select(
        "pair_id", "runs", verdict.alias("verdict"), reasons.alias("reasons"),
        none_of(identity).alias("frozen_identity_match"),
        none_of(sessions).alias("fresh_uncontaminated_sessions"),
        (~F.col("same_arm")).alias("distinct_arm_coverage"),
    )


def demand_retirement(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Verdict of each replayed pair; roles follow the presence of decisive evidence.

    ``conditions(trial_id, condition_id, decisive_evidence_present)``.  A pair with a run whose condition is not
    among them keeps its row, as ``unknown_condition`` with the number of such runs.
    """
    placed = runs.join(conditions.withColumn("_known", F.lit(True)), ["trial_id", "condition_id"], "left")
    present = F.col("decisive_evidence_present")
    role = lambda c, has: F.max(F.when(present == has, F.col(c)))
    grouped = placed.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("runs"),
        (~reduce(lambda a, b: a | b, [_drift(c) for c in FROZEN])).alias("frozen_identity_match"),
        (
            F.bool_and("fresh_session") & ~F.bool_or("prior_condition_exposure") & _drift("session_id")
            & _drift("run_id") & (F.min("sequence_index") == 1) & (F.max("sequence_index") == 2)
        ).alias("fresh_uncontaminated_sessions"),
        (F.coalesce(F.bool_or(present) & ~F.bool_and(present), F.lit(False)) & _drift("condition_id")).alias("decisive_evidence_flip"),
        F.count_if(F.col("_known").isNull()).alias("unknown_conditions"),
        role("condition_id", False).alias("_bc"), role("condition_id", True).alias("_tc"),
        role("outcome", False).alias("_bo"), role("outcome", True).alias("_to"),
    )
    base, treat = F.col("_bo"), F.col("_to")
    verdict = (
        F.when(F.col("unknown_conditions") > 0, "unknown_condition")
        .when(F.col("runs") != 2, "rejected")
        .when(~F.col("frozen_identity_match") | ~F.col("fresh_uncontaminated_sessions"), "confounded")
        .when(~F.col("decisive_evidence_flip"), "invalid_evidence_pair")
        .when((base == "failed") & (treat == "success"), "paired_retirement_signal")
        .when((base == "correct_escalation") & (treat == "success"), "correct_escalation_then_success")
        .when(base == "success", "no_demand_observed")
        .otherwise("demand_persists")
    )
    roles = lambda c: F.when(F.col("decisive_evidence_flip"), F.col(c))
    return grouped.select(
        "pair_id", verdict.alias("verdict"), "unknown_conditions", "frozen_identity_match", "fresh_uncontaminated_sessions",
        "decisive_evidence_flip", roles("_bc").alias("baseline_condition"), roles("_tc").alias("treatment_condition"),
        roles("_bo").alias("baseline_outcome"), roles("_to").alias("treatment_outcome"),
    )


COORDINATES = ["trial_spec", "repository", "revision", "target_path", "target_blob"]
FINGERPRINTS = ["task", "patch", "completion_contract"]


def run_violations(runs: DataFrame, manifests: DataFrame, manifest_conditions: DataFrame) -> DataFrame:
    """Runs that do not match the frozen manifest of their trial, with the first reason."""
    frozen = manifests.select("trial_id", *[F.col(c).alias(f"_m_{c}") for c in COORDINATES + FINGERPRINTS])
    packets = manifest_conditions.select("trial_id", "condition_id", F.col("packet").alias("_m_packet"))
    differs = lambda names: reduce(lambda a, b: a | b, [F.col(c) != F.col(f"_m_{c}") for c in names])
    reason = (
        F.when(F.col("_m_trial_spec").isNull(), "unknown_trial")
        .when(differs(COORDINATES), "coordinate_mismatch")
        .when(differs(FINGERPRINTS), "fingerprint_mismatch")
        .when(F.col("_m_packet").isNull(), "unknown_condition")
        .when(F.col("packet") != F.col("_m_packet"), "packet_mismatch")
    )
    return (
        runs.join(frozen, "trial_id", "left")
        .join(packets, ["trial_id", "condition_id"], "left")
        .select("run_id", "trial_id", "condition_id", reason.alias("reason"))
        .where("reason IS NOT NULL")
    )


RECIPE = ["packet_kind", "budget_bytes", "scope"]


def manifest_drift(spec_conditions: DataFrame, manifest_conditions: DataFrame) -> DataFrame:
    """Conditions that differ between the declared spec and the materialised manifest."""
    key = ["trial_id", "condition_id"]
    cols = RECIPE + ["decisive_evidence_present"]
    side = lambda df, p: df.select(*key, F.struct(*cols).alias(p))
    spec, made = F.col("_spec"), F.col("_made")
    recipe = reduce(lambda a, b: a | b, [~spec[c].eqNullSafe(made[c]) for c in RECIPE])
    reason = (
        F.when(made.isNull(), "missing_condition")
        .when(spec.isNull(), "undeclared_condition")
        .when(recipe, "recipe_drift")
        .when(~spec["decisive_evidence_present"].eqNullSafe(made["decisive_evidence_present"]), "evidence_drift")
    )
    return (
        side(spec_conditions, "_spec").join(side(manifest_conditions, "_made"), key, "full")
        .select(*key, reason.alias("reason"))
        .where("reason IS NOT NULL")
    )


def assign_order(pairs: DataFrame, seed: str) -> DataFrame:
    """AB or BA by the parity of the first byte of SHA-256(seed NUL pair)."""
    hashed = F.sha2(F.concat(F.lit(seed), F.lit("\x00"), F.col("pair_id")), 256)
    odd = F.conv(F.substring(hashed, 2, 1), 16, 10).cast("int") % 2 == 1
    return pairs.select("pair_id", F.when(odd, "ba").otherwise("ab").alias("order"))


# Boundaries at which asking for the missing fact is the right answer.
ESCALATION_BOUNDARIES = ["specification_gap", "evidence_absent", "selection_miss", "affordance_miss"]


def _boundary(selected: Column) -> Column:
    """First boundary an unfinished episode failed at; ``selected`` may be assumed for a recovery."""
    needs = F.col("evidence_required")
    return (
        F.when(F.col("contract_satisfied"), "none")
        .when(~F.col("specification_complete"), "specification_gap")
        .when(needs & ~F.col("evidence_available"), "evidence_absent")
        .when(needs & ~F.col("evidence_valid"), "evidence_misrepresented")
        .when(needs & ~selected, "selection_miss")
        .when(needs & ~F.col("evidence_inspected"), "attention_miss")
        .when(F.col("interpretation_matches") == F.lit(False), "interpretation_miss")
        .when(F.col("plan_matches") == F.lit(False), "planning_miss")
        .when(~F.col("affordance_available"), "affordance_miss")
        .when(~F.col("implementation_completed"), "execution_miss")
        .when(~F.col("validation_completed"), "validation_miss")
        .when(F.col("reported_complete"), "completion_contract_miss")
        .otherwise("unexplained")
    )


def failure_boundaries(episode_facts: DataFrame) -> DataFrame:
    """Boundary, response quality, and the boundary behind a manually recovered selection."""
    boundary = F.col("boundary")
    response = (
        F.when(boundary == "none", "success")
        .when(F.col("requested_discriminator") & boundary.isin(ESCALATION_BOUNDARIES), "correct_escalation")
        .otherwise("failed")
    )
    behind = _boundary(F.lit(True))
    downstream = F.when(
        (boundary == "selection_miss") & F.col("evidence_recovered") & ~behind.isin("none", "unexplained"), behind
    )
    return episode_facts.withColumn("boundary", _boundary(F.col("evidence_selected"))).select(
        "episode_id", "boundary", response.alias("response"), downstream.alias("downstream")
    )


def boundary_counts(boundaries: DataFrame) -> DataFrame:
    return boundaries.groupBy("boundary", "response", "downstream").agg(F.count(F.lit(1)).alias("episodes"))
