"""Discriminator observations, their partitions and frontiers.

``observations(observation_id, discriminator_id, subject_ref, value_ref, applicability)``: a null
``value_ref`` is a recorded unknown, not an absent row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _currentness() -> Column:
    return (
        F.when(F.col("applicability") == "invalid", "invalid")
        .when((F.col("applicability") == "unknown") | F.col("value_ref").isNull(), "unknown")
        .otherwise("current")
    )


def currentness(observations: DataFrame) -> DataFrame:
    return observations.withColumn("state", _currentness())


def partition_members(observations: DataFrame) -> DataFrame:
    """Members of each partition; only current observations are split by value."""
    return currentness(observations).select(
        "discriminator_id",
        "state",
        F.when(F.col("state") == "current", F.col("value_ref")).alias("partition_value"),
        "observation_id",
        "subject_ref",
    )


def discriminator_partitions(observations: DataFrame) -> DataFrame:
    """Size of each partition with its first and last member."""
    return (
        partition_members(observations)
        .groupBy("discriminator_id", "state", "partition_value")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.min("observation_id").alias("first_observation"),
            F.max("observation_id").alias("last_observation"),
        )
    )


def frontiers(requirements: DataFrame, observations: DataFrame) -> DataFrame:
    """current > unknown > invalid > missing per requirement, and the next action.

    Receipts about other subjects are counted from one total per discriminator instead of
    pairing every requirement with every observation of its discriminator.
    """
    key = ["discriminator_id", "subject_ref"]
    own = currentness(observations).groupBy(*key).agg(
        *[F.count_if(F.col("state") == s).alias(f"_{s}") for s in ["current", "unknown", "invalid"]],
        F.count(F.lit(1)).alias("_own"),
    )
    totals = own.groupBy("discriminator_id").agg(F.sum("_own").alias("_all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    status = (
        F.when(zero("_current") > 0, "current")
        .when(zero("_unknown") > 0, "unknown")
        .when(zero("_invalid") > 0, "invalid")
        .otherwise("missing")
    )
    action = (
        F.when(F.col("status") == "current", "proceed_bounded")
        .when(F.col("status") == "invalid", "reject_stale")
        .otherwise("request_discriminator")
    )
    return (
        requirements.select(*key).distinct()
        .join(own, key, "left")
        .join(totals, "discriminator_id", "left")
        .withColumn("status", status)
        .select(
            *key, "status", zero("_current").alias("current"), zero("_unknown").alias("unknown"),
            zero("_invalid").alias("invalid"), (zero("_all") - zero("_own")).alias("other_subject"),
            action.alias("next_action"),
        )
    )


def frontier_receipts(requirements: DataFrame, observations: DataFrame) -> DataFrame:
    """The receipts behind a frontier, one row each."""
    key = ["discriminator_id", "subject_ref"]
    return currentness(observations).join(requirements.select(*key).distinct(), key, "left_semi").select(
        *key, "state", "observation_id", "value_ref"
    )
