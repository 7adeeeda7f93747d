"""Evidence requirements evaluated in contexts.

``evidence(evidence_id, context_set, repository, revision, work, scope_mode, scope_path)`` is
asked in every context of its set: ``contexts(context_set, context_id, repository, revision,
work, path)``.  The set key makes this an equi-join; there is no product of both tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import (
    CONTEXT_FIELDS, dimension_evaluations, exact_status, fields, has_requirement, overall_status,
)
from ..functions.identity import is_snapshot_id


def _in_context(evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    asked = contexts.select(
        "context_set", "context_id", *[F.col(f).alias(f"_ctx_{f}") for f in CONTEXT_FIELDS]
    )
    return evidence.join(asked, "context_set")


def evaluate_dimensions(evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per evidence, context and required dimension."""
    cells = dimension_evaluations(fields(""), fields("_ctx_"))
    return _in_context(evidence, contexts).select(
        "evidence_id", "context_id", F.inline(cells)
    )


def applicability(evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """applies / invalid / unknown per evidence and context; ``rejected`` asks for nothing."""
    status = F.when(
        has_requirement(fields("")), overall_status(fields(""), fields("_ctx_"))
    ).otherwise("rejected")
    return _in_context(evidence, contexts).select(
        "evidence_id", "context_set", "context_id", status.alias("status")
    )


def snapshot_applicability(required: DataFrame, current: DataFrame) -> DataFrame:
    """``required(ref, collection, required_id, stored_status)`` against the current identity of
    its collection; malformed identities are rejected, stale stored statuses are flagged."""
    now = current.select("collection", F.col("snapshot_id").alias("actual_id"))
    well_formed = is_snapshot_id(F.col("required_id")) & (
        F.col("actual_id").isNull() | is_snapshot_id(F.col("actual_id"))
    )
    status = F.when(~well_formed, "rejected").otherwise(
        exact_status(F.col("required_id"), F.col("actual_id"))
    )
    return (
        required.join(now, "collection", "left")
        .withColumn("status", status)
        .select(
            "ref", "required_id", "actual_id", "status",
            F.coalesce(F.col("stored_status") == F.col("status"), F.lit(True)).alias("stored_agrees"),
        )
    )
