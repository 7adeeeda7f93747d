"""JSON packets in, reports out, and attribute files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: the attribute that marks a path as generated.
GENERATED_ATTRIBUTE = "linguist-generated=true"


def read_packets(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = True) -> DataFrame:
    """One row per document, typed by ``schema``; nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def unnest(packets: DataFrame, array: str, *keys: str) -> DataFrame:
    """Elements of a nested array of structs as rows that keep the packet's keys."""
    return packets.select(*keys, F.explode(array).alias("_item")).select(*keys, "_item.*")


def parse_packets(raw: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    return raw.withColumn("packet", F.from_json(column, schema))


def write_report(df: DataFrame, path: str, partition_by: str | None = "repository", mode: str = "errorifexists") -> None:
    """Nested JSON lines, one folder per repository."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)


def generated_paths(attribute_files: DataFrame) -> DataFrame:
    """Paths marked as generated in ``attribute_files(repository, source)``."""
    lines = F.transform(F.split("source", "\r?\n", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("#"))
    path = F.regexp_replace(F.replace(F.get("_t", F.lit(0)), F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    return (
        attribute_files.select("repository", F.explode(F.transform(kept, lambda s: F.split(s, r"\s+"))).alias("_t"))
        .where(F.array_contains(F.slice("_t", F.lit(2), F.size("_t")), GENERATED_ATTRIBUTE))
        .select("repository", path.alias("path"))
        .distinct()
    )
