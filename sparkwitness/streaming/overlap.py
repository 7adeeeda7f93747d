"""Overlap of active work while its paths arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_stream(work_paths: DataFrame, window: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Stream of ``work_paths(snapshot_id, id, is_current, path, seen_at)`` joined with itself.

    Paths of a current item meet the paths of other items of the snapshot seen within
    ``window`` before or after; the window bounds the state on both sides, and each overlap is
    reported once.
    """
    arriving = work_paths.withWatermark("seen_at", delay)
    mine = arriving.where("is_current").select(
        "snapshot_id", "path", F.col("id").alias("current_id"), F.col("seen_at").alias("current_seen_at")
    )
    others = arriving.where("NOT is_current").select(
        F.col("snapshot_id").alias("_snapshot"), F.col("path").alias("_path"), F.col("id").alias("other_id"), F.col("seen_at").alias("other_seen_at")
    )
    span = F.expr(f"INTERVAL {window}")
    near = F.col("other_seen_at").between(F.col("current_seen_at") - span, F.col("current_seen_at") + span)
    pairs = mine.join(
        others, (F.col("snapshot_id") == F.col("_snapshot")) & (F.col("path") == F.col("_path")) & near
    )
    key = ["snapshot_id", "current_id", "other_id", "path"]
    # One event time is left: the deduplication measures its delay on it.
    once = pairs.select(*key, "current_seen_at").dropDuplicatesWithinWatermark(key)
    return once.select(*key)
