"""Naming conventions of ``facts(repository, path, name, line)`` and changes against them.

Counts per name are aggregated first; everything else works on those counts, so a repository
with very many facts, or one very frequent name, is never walked by a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 16  # keys over which the findings of one file are dealt


def _counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("repository", "name").agg(F.count(F.lit(1)).alias("n"))


def _totals(counts: DataFrame) -> DataFrame:
    """Per repository: total, distinct names, the highest count and how many names share it."""
    levels = counts.groupBy("repository", "n").agg(F.count(F.lit(1)).alias("_names"))
    return levels.groupBy("repository").agg(
        F.sum(F.col("n") * F.col("_names")).alias("total"),
        F.sum("_names").alias("distinct_names"),
        F.max("n").alias("_top"),
        F.max_by("_names", "n").alias("_tied"),
    )


def name_distribution(facts: DataFrame) -> DataFrame:
    counts = _counts(facts)
    top = F.col("n") == F.col("_top")
    return counts.join(_totals(counts), "repository").select(
        "repository", "name", "n", "total", "distinct_names",
        (top & (F.col("_tied") == 1)).alias("is_dominant"),
        (top & (F.col("_tied") > 1)).alias("tied"),
    )


def local_mix(facts: DataFrame) -> DataFrame:
    """Names of every file that uses more than one; one row per name."""
    per_file = facts.groupBy("repository", "path", "name").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("line").alias("first_line")
    )
    mixed = per_file.groupBy("repository", "path").agg(F.count(F.lit(1)).alias("distinct_names")).where("distinct_names > 1")
    return per_file.join(mixed, ["repository", "path"])


def one_offs(facts: DataFrame) -> DataFrame:
    """Facts whose name occurs once in a repository that has other facts."""
    counts = _counts(facts)
    totals = counts.groupBy("repository").agg(F.sum("n").alias("total")).where("total > 1")
    single = counts.where("n = 1").join(totals, "repository").select("repository", "name", "total")
    return facts.join(single, ["repository", "name"]).select("repository", "path", "line", "name", "total")


def precedent_findings(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed facts whose name departs from their file or from the repository.

    ``changed`` are rows of ``facts`` inside changed ranges.  A fact does not count as its own
    precedent.  The three most frequent names per repository suffice to find the unique dominant
    name once one occurrence of the own name is taken away.
    """
    counts = _counts(facts)
    totals = counts.groupBy("repository").agg(F.sum("n").alias("_total"))
    order = Window.partitionBy("repository").orderBy(F.desc("n"), "name")
    leaders = (
        counts.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= 3)
        .groupBy("repository")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "name", "n"))).alias("_leaders"))
    )
    per_file_name = facts.groupBy("repository", "path", "name").agg(F.count(F.lit(1)).alias("_own_in_file"))
    per_file = per_file_name.groupBy("repository", "path").agg(
        F.count(F.lit(1)).alias("_names"), F.min("name").alias("_low"), F.max("name").alias("_high")
    )
    others = F.filter("_leaders", lambda x: x["name"] != F.col("name"))
    first, second = F.get(others, F.lit(0)), F.get(others, F.lit(1))
    own = F.col("repository_count")
    best = F.coalesce(first["n"], F.lit(0))
    dominant = (
        F.when((own > 0) & (own > best), F.col("name"))
        .when((own > 0) & (own == best), None)
        .when(first.isNotNull() & (best > F.coalesce(second["n"], F.lit(0))), first["name"])
    )
    only_self = F.col("_own_in_file") == 1
    file_name = (
        F.when((F.col("_names") == 1) & ~only_self, F.col("name"))
        .when((F.col("_names") == 2) & only_self, F.when(F.col("_low") == F.col("name"), F.col("_high")).otherwise(F.col("_low")))
    )
    tension = F.col("_dominant") != F.col("_local")
    alignment = (
        F.when(F.col("name") == F.col("_dominant"), "repository").when(F.col("name") == F.col("_local"), "file").otherwise("neither")
    )
    return (
        changed.select("repository", "path", "line", "name")
        .join(counts.select("repository", "name", (F.col("n") - 1).alias("repository_count")), ["repository", "name"])
        .join(totals, "repository")
        .join(leaders, "repository")
        .join(per_file_name, ["repository", "path", "name"])
        .join(per_file, ["repository", "path"])
        .withColumn("_dominant", dominant)
        .withColumn("_local", file_name)
        .withColumn("precedent_total", F.col("_total") - 1)
        .withColumn("different_local_names", F.col("_names") - 1)
        .withColumn("one_off", (own == 0) & (F.col("precedent_total") > 0))
        .where((F.col("different_local_names") > 0) | F.col("one_off"))
        .withColumn("_tension", F.coalesce(tension, F.lit(False)))
        .select(
            "repository", "path", "line", "name", "repository_count", "precedent_total", "different_local_names", "one_off",
            F.when(F.col("_tension"), "precedent_tension").otherwise("precedent").alias("finding_kind"),
            F.when(F.col("_tension"), F.col("_dominant")).alias("repository_name"),
            F.when(F.col("_tension"), F.col("_local")).alias("file_name"),
            F.when(F.col("_tension"), alignment).alias("alignment"),
        )
    )


def precedent_local_names(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """The other names of a finding's file, one row each.

    The result is findings times names of each file.  A file's findings are dealt over ``SPREAD`` keys that all get its
    names, and all of them over as many tasks as the session shuffles to, so few files or little input are no few large tasks.
    """
    names = facts.select("repository", "path", F.col("name").alias("local_name")).distinct()
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = findings.select("repository", "path", "line", "name").withColumn("_part", F.pmod(F.xxhash64("line", "name"), F.lit(SPREAD)))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))
    return (
        dealt.repartition(tasks, "repository", "path", "_part")
        .join(names.withColumn("_part", parts), ["repository", "path", "_part"])
        .where(F.col("local_name") != F.col("name")).drop("_part")
    )
