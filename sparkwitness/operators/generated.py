"""Generator relations and generated files that did not follow their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import kept

MIN_COHORT = 3


def generator_relations(aliases: DataFrame, generator_io: DataFrame) -> DataFrame:
    """alias -> package -> function reads x writes, distinct.

    ``aliases(repository, alias, package)``, ``generator_io(repository, package, generator_path,
    function, reads array, writes array)``.
    """
    return (
        aliases.join(generator_io, ["repository", "package"])
        .withColumn("input", F.explode("reads"))
        .withColumn("output", F.explode("writes"))
        .select("repository", "alias", "package", "generator_path", "function", "input", "output")
        .distinct()
    )


def missing_companions(
    change_paths: DataFrame,
    relations: DataFrame,
    files: DataFrame,
    attributed: DataFrame,
    markers: DataFrame,
    cohorts: DataFrame,
    min_cohort: int = MIN_COHORT,
) -> DataFrame:
    """Inputs with a syntax change whose generated output stayed behind.

    Reported only if the output exists, is attributed and marked as generated, is not part of
    the change, and followed every one of at least ``min_cohort`` syntax changes before.
    ``change_paths(repository, change_id, path, change_class)``, ``cohorts(repository, source,
    output, opportunities, support)``.  The pairs that qualify are written once, and changes of other paths left out before any is shuffled.
    """
    pair = relations.select("repository", "input", "output").distinct()
    eligible = (
        pair.join(files.select("repository", F.col("path").alias("output")), ["repository", "output"], "left_semi")
        .join(attributed.select("repository", F.col("path").alias("output")), ["repository", "output"], "left_semi")
        .join(
            markers.select("repository", F.col("path").alias("output"), F.col("line").alias("marker_line"), "marker"),
            ["repository", "output"],
        )
        .join(
            cohorts.where((F.col("opportunities") >= min_cohort) & (F.col("support") == F.col("opportunities"))).select(
                "repository", F.col("source").alias("input"), "output", "opportunities", "support"
            ),
            ["repository", "input", "output"],
        )
    )
    eligible = kept(eligible, "eligible")
    changed = change_paths.where(F.col("change_class") == "syntax_changed").select(
        "repository", "change_id", F.col("path").alias("input")
    )
    present = change_paths.select("repository", "change_id", F.col("path").alias("output")).join(
        eligible.select("repository", "output"), ["repository", "output"], "left_semi")
    return (
        changed.join(eligible, ["repository", "input"])
        .join(present, ["repository", "change_id", "output"], "left_anti")
        .select("repository", "change_id", "input", "output", "marker_line", "marker", "opportunities", "support")
    )
