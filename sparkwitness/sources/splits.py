"""Delimited records of text files of any size, with their exact place.

Spark cuts a file into splits and reads each record where it starts.  A record's place is its split, which starts at a byte of
the file, and its order within it; numbers across splits follow from the counts of the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, separator: str, named: bool = True) -> DataFrame:
    """(name, split, place, value): every record of the files below ``path``.

    ``name`` is as ``file_name`` states; not ``named``, it is the file's whole path, which costs nothing per record.  ``split``
    and ``place`` only order the records of a file.
    """
    file = F.col("_metadata.file_path")
    return spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path).select(
        (file_name(spark, path, file) if named else file).alias("name"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), "value",
    )


def file_name(spark: SparkSession, path: str, file: Column) -> Column:
    """The file's path relative to ``path``, without its extension; for a single file its own name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getRawPath().rstrip("/")
    below = F.when(F.contains(file, F.lit(root + "/")), F.substring_index(file, root + "/", -1)).otherwise(F.substring_index(file, "/", -1))
    return F.url_decode(F.replace(F.regexp_replace(below, r"\.[^./]*$", ""), F.lit("+"), F.lit("%2B")))


def numbered(records: DataFrame, out: str) -> DataFrame:
    """``records`` with their number in their file, from 0."""
    counts = records.groupBy("name", "split").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("name").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("name", "split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("name", "split").orderBy("place")
    return records.withColumn("_row", F.row_number().over(within) - 1).join(offsets, ["name", "split"]).withColumn(
        out, F.col("_offset") + F.col("_row")).drop("_row", "_offset")
