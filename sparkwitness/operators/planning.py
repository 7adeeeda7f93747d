"""Choosing the cheapest admissible probe for an obligation.

``probes(obligation_id, probe_id, kind, target, <requirement fields>, effect, git_subprocesses,
files_parsed, remote_requests, effectful_executions)`` lists the probes offered to an obligation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import CONTEXT_FIELDS, REQUIREMENT_FIELDS, fields, overall_status
from .obligations import requirement_key

# Order in which effects are preferred.
EFFECT_RANK = {"read_only": 0, "external_read": 1, "effectful": 2}
COSTS = ["remote_requests", "git_subprocesses", "files_parsed", "effectful_executions"]
MAX_COST_UNIT = 1_000_000


def _placed(obligations: DataFrame, contexts: DataFrame) -> DataFrame:
    ctx = contexts.select("context_set", *[F.col(f).alias(f"_ctx_{f}") for f in CONTEXT_FIELDS])
    return obligations.join(ctx, "context_set", "left").withColumn(
        "_subject", overall_status(fields(""), fields("_ctx_"))
    )


def probe_candidates(
    obligations: DataFrame,
    conditions: DataFrame,
    probes: DataFrame,
    contexts: DataFrame,
    allow_effectful: bool = False,
) -> DataFrame:
    """Status of every offered probe; a stale obligation has no candidates.

    ``obligations`` also names its missing discriminator: ``missing_kind, missing_target``.
    """
    open_ones = _placed(obligations, contexts).where(F.col("_subject") != "invalid").select(
        "obligation_id", "missing_kind", "missing_target", *[f"_ctx_{f}" for f in CONTEXT_FIELDS]
    )
    # An obligation's own conditions as one list: the probes then meet all they need on one key, in the order of one sort.
    admitted = conditions.groupBy("obligation_id").agg(F.collect_set(requirement_key("kind", "target")).alias("_keys"))
    capable = (F.col("kind") == F.col("missing_kind")) & (F.col("target") == F.col("missing_target"))
    is_admitted = F.coalesce(F.array_contains("_keys", requirement_key("kind", "target")), F.lit(False))
    applies = overall_status(fields(""), fields("_ctx_"))
    status = (
        F.when(~capable, "incapable")
        .when(~is_admitted, "incompatible_clearing_condition")
        .when(applies == "invalid", "invalid_coordinate")
        .when(applies == "unknown", "missing_context")
        .when((F.col("effect") == "effectful") & ~F.lit(allow_effectful), "effect_authority_required")
        .otherwise("eligible")
    )
    return (
        probes.join(open_ones, "obligation_id")
        .join(admitted, "obligation_id", "left")
        .select("obligation_id", "probe_id", status.alias("status"), "effect", *COSTS)
    )


def plan_probes(obligations: DataFrame, contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """selected / blocked / unresolved / stale_obligation, with the cheapest eligible probe."""
    rank = F.coalesce(
        *[F.when(F.col("effect") == e, F.lit(r)) for e, r in EFFECT_RANK.items()]
    )
    eligible = F.col("status") == "eligible"
    order = F.when(eligible, F.struct(rank.alias("rank"), *COSTS, "probe_id"))
    per_obligation = candidates.groupBy("obligation_id").agg(
        F.min(order)["probe_id"].alias("selected"),
        F.bool_or(F.col("status").isin("missing_context", "effect_authority_required")).alias("_blocked"),
        F.count(F.lit(1)).alias("_candidates"),
    )
    # Planned before any receipt exists: the obligation is unknown exactly if its subject is.
    status = (
        F.when(F.col("_subject") == "invalid", "stale_obligation")
        .when(F.col("selected").isNotNull(), "selected")
        .when((F.col("_subject") == "unknown") | F.coalesce("_blocked", F.lit(False)), "blocked")
        .otherwise("unresolved")
    )
    return (
        _placed(obligations, contexts)
        .join(per_obligation, "obligation_id", "left")
        .select(
            "obligation_id", status.alias("status"), "selected",
            F.coalesce("_candidates", F.lit(0).cast("long")).alias("candidates"),
        )
    )


def probe_cost_violations(probes: DataFrame) -> DataFrame:
    """Forecasts that contradict the effect class of the probe."""
    effect = F.col("effect")
    over = F.greatest(*COSTS) > MAX_COST_UNIT
    reason = (
        F.when(over, "cost_out_of_range")
        .when(
            (effect == "read_only") & ((F.col("remote_requests") != 0) | (F.col("effectful_executions") != 0)),
            "read_only_forecasts_outside_work",
        )
        .when((effect == "external_read") & (F.col("remote_requests") == 0), "external_read_without_request")
        .when((effect == "external_read") & (F.col("effectful_executions") != 0), "external_read_forecasts_execution")
        .when((effect == "effectful") & (F.col("effectful_executions") == 0), "effectful_without_execution")
    )
    return probes.select("obligation_id", "probe_id", "effect", reason.alias("reason")).where("reason IS NOT NULL")


def plan_observation_probes(
    frontiers: DataFrame,
    bridges: DataFrame,
    probes: DataFrame,
    contexts: DataFrame,
    allow_effectful: bool = False,
) -> DataFrame:
    """Probe plan of each frontier that is not current, through an admitted bridge.

    ``bridges(bridge_id, discriminator_id, subject_ref, context_set, kind, target,
    <requirement fields>)``; offered probes name their ``bridge_id``.
    """
    key = ["discriminator_id", "subject_ref"]
    first = bridges.groupBy(*key).agg(
        F.min_by(F.struct("bridge_id", "context_set", "kind", "target", *REQUIREMENT_FIELDS), "bridge_id").alias("b")
    ).select(*key, "b.*")
    needed = first.join(frontiers.where(F.col("status") != "current").select(*key), key, "left_semi")
    obligations = needed.select(
        F.col("bridge_id").alias("obligation_id"), "context_set",
        F.col("kind").alias("missing_kind"), F.col("target").alias("missing_target"), *REQUIREMENT_FIELDS,
    )
    conditions = needed.select(F.col("bridge_id").alias("obligation_id"), "kind", "target", *REQUIREMENT_FIELDS)
    offered = probes.withColumnRenamed("bridge_id", "obligation_id")
    candidates = probe_candidates(obligations, conditions, offered, contexts, allow_effectful)
    plans = plan_probes(obligations, contexts, candidates).select(
        F.col("obligation_id").alias("bridge_id"), F.col("status").alias("plan_status"), "selected"
    )
    status = (
        F.when(F.col("status") == "current", "already_current")
        .when(F.col("bridge_id").isNull(), "no_admitted_mapping")
        .otherwise("planned")
    )
    return (
        frontiers.select(*key, "status")
        .join(needed.select(*key, "bridge_id"), key, "left")
        .join(plans, "bridge_id", "left")
        .select(*key, F.col("status").alias("frontier_status"), status.alias("status"), "bridge_id", "plan_status", "selected")
    )
