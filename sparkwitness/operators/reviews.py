"""Review memory: is there already a thread about this concern?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import CONTEXT_FIELDS
from ..functions.paths import scope_matches


def review_matches(concerns: DataFrame, review_events: DataFrame) -> DataFrame:
    """Match kind of every recorded event about the same concern.

    ``concerns(concern_id, concern_key, repository, revision, work, path)``,
    ``review_events(event_id, concern_key, repository, revision, work, scope_mode, scope_path, outcome)``.
    """
    now = concerns.select("concern_id", "concern_key", *[F.col(f).alias(f"_now_{f}") for f in CONTEXT_FIELDS])
    known = lambda test: F.coalesce(test, F.lit(False))
    differs = known(F.col("repository") != F.col("_now_repository")) | known(F.col("work") != F.col("_now_work")) | known(
        ~scope_matches(F.col("scope_mode"), F.col("scope_path"), F.col("_now_path"))
    )
    missing = (
        F.col("_now_repository").isNull()
        | F.col("_now_work").isNull()
        | (F.col("scope_path").isNotNull() & F.col("_now_path").isNull())
    )
    kind = (
        F.when(differs, "unrelated")
        .when(missing, "context_missing")
        .when(F.col("_now_revision").isNull(), "context_missing")
        .when(F.col("revision") == F.col("_now_revision"), "current")
        .otherwise("prior_head")
    )
    return review_events.join(now, "concern_key").select(
        "concern_id", "concern_key", "event_id", "outcome", kind.alias("match_kind")
    )


def review_disposition(concerns: DataFrame, matches: DataFrame) -> DataFrame:
    """need_context / reuse_current_thread / refresh_existing_thread / new_thread per concern."""
    has = lambda k: F.bool_or(F.col("match_kind") == k).alias(f"_{k}")
    found = matches.groupBy("concern_id").agg(
        has("current"), has("prior_head"), has("context_missing"), F.count(F.lit(1)).alias("_n")
    )
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ["repository", "revision", "work"]])
    disposition = (
        F.when(incomplete, "need_context")
        .when(F.col("_current"), "reuse_current_thread")
        .when(F.col("_prior_head"), "refresh_existing_thread")
        .when(F.col("_context_missing"), "need_context")
        .otherwise("new_thread")
    )
    return concerns.join(found, "concern_id", "left").select(
        "concern_id", disposition.alias("disposition"), F.coalesce("_n", F.lit(0).cast("long")).alias("matches")
    )


def review_events(comments: DataFrame, selections: DataFrame) -> DataFrame:
    """Selected root comments and resolutions as review events, or the broken rule.

    ``comments(repository, pull, comment_id, in_reply_to_id, path, commit_id)``,
    ``selections(selection_id, repository, pull, root_id, outcome, resolution_id)``.
    """
    key = ["repository", "pull"]
    side = lambda name: comments.select(
        *key,
        F.col("comment_id").alias(f"{name}_id"),
        F.struct("in_reply_to_id", "path", "commit_id").alias(f"_{name}"),
    )
    root, resolution = F.col("_root"), F.col("_resolution")
    selected = F.col("resolution_id").isNotNull()
    violation = (
        F.when((F.col("outcome") == "open") & selected, "open_with_resolution")
        .when((F.col("outcome") != "open") & ~selected, "closed_without_resolution")
        .when(root.isNull(), "root_absent")
        .when(root["in_reply_to_id"].isNotNull(), "root_is_reply")
        .when(selected & resolution.isNull(), "resolution_absent")
        .when(
            selected & ~resolution["in_reply_to_id"].eqNullSafe(F.col("root_id")), "resolution_not_direct_reply"
        )
    )
    ok = lambda c: F.when(F.col("violation").isNull(), c)
    return (
        selections.join(side("root"), [*key, "root_id"], "left")
        .join(side("resolution"), [*key, "resolution_id"], "left")
        .withColumn("violation", violation)
        .select(
            "selection_id", *key, "violation", "outcome",
            ok(F.col("root_id")).alias("root_id"),
            ok(root["commit_id"]).alias("revision"),
            ok(root["path"]).alias("scope_path"),
            ok(F.col("resolution_id")).alias("resolution_id"),
        )
    )
