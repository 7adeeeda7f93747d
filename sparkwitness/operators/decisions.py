"""Recorded decisions and guidance that apply to a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, fresh_folder
from ..plans.scopes import with_ancestors

# Names of guidance files.
GUIDANCE_FILES = ["AGENTS.md", "CONTRIBUTING.md"]


def decisions_for(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """``decisions(repository, decision_id, path_prefix)`` above ``targets(repository, target)``."""
    reach = with_ancestors(targets.select("repository", "target").distinct(), "target", "path_prefix")
    return decisions.select("repository", "decision_id", "path_prefix").join(
        reach, ["repository", "path_prefix"]
    ).select("repository", "target", "decision_id", "path_prefix", F.lit("direct").alias("matched_via"), F.col("target").alias("matched_path"))


def file_lineage(renames: DataFrame, targets: DataFrame, on_round=None) -> DataFrame:
    """All earlier paths of each target, along ``renames(repository, old_path, new_path)``.

    Chains of any length are followed by pointer jumping: a round joins the paths reached so far
    with jumps of length 2^k, then doubles the jumps.  Only renames of repositories with targets take part, and a jump is
    kept only from a path that a target has reached or that another jump lands on, so stretches in front of all targets
    fall away.  The number of rounds is logarithmic in the longest chain; the loop ends when no jump is left, or on cycles when a
    round reaches nothing new.  Each round is written to the shared folder and the one before it deleted, so the plan
    does not grow and a lost executor costs one round.  ``on_round`` is told (round, paths reached, jumps kept).
    """
    spark = targets.sparkSession
    wanted = targets.select("repository", "target").distinct()
    reach = wanted.withColumn("path", F.col("target"))
    jump = renames.join(wanted.select("repository").distinct(), "repository", "left_semi").select(
        "repository", F.col("new_path").alias("path"), F.col("old_path").alias("_next")
    ).where(F.col("path") != F.col("_next")).distinct()
    folders: list[str] = []

    def put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        folder = fresh_folder(spark, name)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder), folder

    jump, at = put(jump, "lineage-renames")  # the first round reads it four times
    folders.append(at)
    known, number = None, 0
    while True:
        number += 1
        further = reach.join(jump, ["repository", "path"]).select("repository", "target", F.col("_next").alias("path"))
        reach, at = put(reach.unionByName(further).distinct(), "lineage-reach")
        size = reach.count()
        useful = reach.select("repository", "path").unionByName(jump.select("repository", F.col("_next").alias("path"))).distinct()
        onward = jump.select("repository", F.col("path").alias("_next"), F.col("_next").alias("_after"))
        jump, jumps_at = put(
            jump.join(useful, ["repository", "path"], "left_semi").join(onward, ["repository", "_next"])
            .select("repository", "path", F.col("_after").alias("_next")).distinct(), "lineage-jumps",
        )
        left = jump.count()
        for folder in folders:
            discard(spark, folder)
        folders = [at, jumps_at]
        if on_round:
            on_round(number, size, left)
        if not left or size == known:
            discard(spark, jumps_at)
            break
        known = size
    return reach.where(F.col("path") != F.col("target")).select(
        "repository", "target", F.col("path").alias("historical_path")
    )


def decisions_via_lineage(decisions: DataFrame, targets: DataFrame, renames: DataFrame) -> DataFrame:
    """Direct matches, and for the rest the first earlier path (in path order) a decision covers."""
    direct = decisions_for(decisions, targets)
    earlier = file_lineage(renames, targets)
    # The first path is found per prefix that a decision names, before the decisions of that prefix multiply the rows.
    asked = decisions.select("repository", "path_prefix").distinct()
    first = (
        with_ancestors(earlier, "historical_path", "path_prefix").join(asked, ["repository", "path_prefix"], "left_semi")
        .groupBy("repository", "target", "path_prefix").agg(F.min("historical_path").alias("matched_path"))
    )
    through = (
        decisions.select("repository", "decision_id", "path_prefix").distinct()
        .join(first, ["repository", "path_prefix"])
        .join(direct.select("repository", "target", "decision_id"), ["repository", "target", "decision_id"], "left_anti")
        .withColumn("matched_via", F.lit("git_file_lineage"))
    )
    return direct.unionByName(through)


def guidance_for(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Guidance files of every directory above a target; ``depth`` 0 is the root."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("repository", "path", name.alias("guidance_kind")).where(
        F.col("guidance_kind").isin(GUIDANCE_FILES)
    ).withColumn("scope", F.regexp_replace("path", "/?[^/]+$", ""))
    wanted = targets.select("repository", "target").distinct()
    above = with_ancestors(wanted, "target", "scope", include_self=False).unionByName(
        wanted.withColumn("scope", F.lit(""))
    )
    depth = F.when(F.col("scope") == "", 0).otherwise(F.size(F.split("scope", "/")))
    return found.join(above, ["repository", "scope"]).select(
        "repository", "target", "path", "guidance_kind", "scope", depth.cast("long").alias("depth")
    )
