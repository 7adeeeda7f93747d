"""Commit-log export: records start with 0x1E, fields are separated by 0x1F, then one path per line.

A record is ``sha 0x1F date 0x1F subject`` or, with ``with_parents``, ``sha 0x1F parents 0x1F
subject``.  One file per repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .splits import numbered, read_delimited

RECORD, FIELD = "\x1e", "\x1f"
TRIM = r"^\s+|\s+$"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files with their position; position 0 is the newest of a file.

    A file's path below ``path``, without its extension, names the repository, so files of one name in two folders are two.
    """
    raw = read_delimited(spark, path, RECORD).where(F.col("value").rlike(r"\S"))
    return numbered(raw, "log_pos").select(F.col("name").alias("repository"), "log_pos", F.col("value").alias("record"))


def _parsed(records: DataFrame, with_parents: bool) -> DataFrame:
    lines = F.split(F.regexp_replace("record", "^[\n\r]+", ""), "\r?\n", -1)
    head = F.regexp_replace(F.get("_lines", F.lit(0)), TRIM, "")
    fields = F.transform(F.split(head, FIELD, 3), lambda f: F.regexp_replace(f, TRIM, ""))
    middle = F.get("_fields", F.lit(1))
    extra = (
        F.when(middle != "", F.get(F.split(middle, r"\s+"), F.lit(0))).alias("parent_sha")
        if with_parents
        else F.to_timestamp(middle).alias("committed_at")
    )
    return (
        records.select("repository", "log_pos", lines.alias("_lines"))
        .select("repository", "log_pos", "_lines", fields.alias("_fields"))
        .select(
            "repository", "log_pos", F.size("_fields").alias("_width"), F.get("_fields", F.lit(0)).alias("sha"),
            extra, F.get("_fields", F.lit(2)).alias("subject"), "_lines",
        )
    )


def parse_commits(records: DataFrame, with_parents: bool = False) -> DataFrame:
    """``records(repository, log_pos, record)`` to commits; merges are absent by export."""
    rows = _parsed(records, with_parents).where(F.col("_width") == 3)
    return rows.drop("_width", "_lines").withColumn("is_merge", F.lit(False))


def parse_commit_paths(records: DataFrame) -> DataFrame:
    rows = _parsed(records, True).where(F.col("_width") == 3)
    paths = F.transform(F.slice("_lines", F.lit(2), F.size("_lines")), lambda p: F.regexp_replace(p, TRIM, ""))
    return rows.select("repository", "sha", F.explode(F.array_distinct(paths)).alias("path")).where(F.col("path") != "")


def malformed_records(records: DataFrame) -> DataFrame:
    return _parsed(records, True).where(F.col("_width") != 3).select("repository", "log_pos")


def read_commit_log(spark: SparkSession, path: str, with_parents: bool = False) -> tuple[DataFrame, DataFrame]:
    records = read_records(spark, path)
    return parse_commits(records, with_parents), parse_commit_paths(records)
