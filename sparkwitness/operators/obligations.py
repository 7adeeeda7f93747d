"""Durable obligations and the receipts that may clear them.

``conditions`` and ``receipts`` carry ``obligation_id``, a discriminator ``(kind, target)`` and the
five requirement fields.  Equality treats a null requirement as a value, so both sides compare
through one framed key and join on plain equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import CONTEXT_FIELDS, REQUIREMENT_FIELDS, fields, overall_status
from ..functions.identity import framed


def requirement_key(*extra: str) -> Column:
    return framed(*[F.col(c) for c in (*extra, *REQUIREMENT_FIELDS)])


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", requirement_key("kind", "target"))


def _contexts(contexts: DataFrame) -> DataFrame:
    return contexts.select("context_set", *[F.col(f).alias(f"_ctx_{f}") for f in CONTEXT_FIELDS])


def unmatched_receipts(receipts: DataFrame, conditions: DataFrame) -> DataFrame:
    admitted = _keyed(conditions).select("obligation_id", "_key").distinct()
    return (
        _keyed(receipts).join(admitted, ["obligation_id", "_key"], "left_anti").select("obligation_id", "receipt_id")
    )


def durable_obligations(
    obligations: DataFrame, conditions: DataFrame, receipts: DataFrame, contexts: DataFrame
) -> DataFrame:
    """reopen_required / unknown / cleared / open per obligation in the context of its set.

    ``obligations(obligation_id, context_set, <requirement fields of the subject>)`` and one
    context row per set.
    """
    placed = obligations.join(_contexts(contexts), "context_set", "left").withColumn(
        "subject_applicability", overall_status(fields(""), fields("_ctx_"))
    )
    context_only = placed.select("obligation_id", *[f"_ctx_{f}" for f in CONTEXT_FIELDS])
    admitted = _keyed(conditions).select("obligation_id", "_key").distinct()
    cleared = (
        _keyed(receipts)
        .join(admitted, ["obligation_id", "_key"], "left_semi")
        .join(context_only, "obligation_id")
        .withColumn("_status", overall_status(fields(""), fields("_ctx_")))
        .groupBy("obligation_id")
        .agg(*[F.count_if(F.col("_status") == s).alias(f"_{s}") for s in ["applies", "invalid", "unknown"]])
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    subject = F.col("subject_applicability")
    status = (
        F.when(subject == "invalid", "reopen_required")
        .when(subject == "unknown", "unknown")
        .when(zero("_applies") > 0, "cleared")
        .when(zero("_unknown") > 0, "unknown")
        .otherwise("open")
    )
    return placed.join(cleared, "obligation_id", "left").select(
        "obligation_id", "subject_applicability", status.alias("status"),
        zero("_applies").alias("applies"), zero("_invalid").alias("invalid"), zero("_unknown").alias("unknown"),
    )
