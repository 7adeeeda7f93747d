"""Running a stream over everything that is there, and stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import discard, fresh_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "trigger long, rows_in long, state_rows long, state_rows_removed long, late_rows long, watermark string"

SLICES = 64  # tasks that cut the table for one landed range
FILE_ROWS = 250_000  # of a landed file at most, where the rows of its range come evenly


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, with its settings, whose state is kept in RocksDB; the given one is not altered."""
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            beside.conf.set(key, value)
    beside.conf.set(PROVIDER, ROCKS)
    return beside


def land_in_order(rows: DataFrame, time: str, files: int) -> str:
    """Writes ``rows`` as ``files`` ranges that follow each other in event time and arrival; returns their folder.

    A range partitioning into ``SLICES`` tasks a range cuts the table, unsorted, so no task holds a range; each range is then landed on
    its own, as a source would, since a stream takes files by their time of arrival.  A range is one file, or where the largest has more
    than ``FILE_ROWS`` rows as many as it needs: all ranges have equally many, so that ``per_range`` of them are one trigger.
    """
    spark = rows.sparkSession
    cut, landed = fresh_folder(spark, "ranges"), fresh_folder(spark, "landed")
    rows.repartitionByRange(files * SLICES, F.col(time).asc_nulls_first()).withColumn("_slice", F.spark_partition_id()).write.parquet(cut)
    whole = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(cut)
    sizes = {r["_slice"]: r["count"] for r in whole.groupBy("_slice").count().collect()}  # a row per slice
    n = max(sizes, default=0) + 1  # few different times give fewer slices
    ends = [n * k // files for k in range(files + 1)]
    largest = max(sum(sizes.get(at, 0) for at in range(low, high)) for low, high in zip(ends, ends[1:]))
    pieces = max(-(-largest // FILE_ROWS), 1)
    for k in range(files):
        mine = whole.where(F.col("_slice").between(ends[k], ends[k + 1] - 1)).drop("_slice")
        (mine.coalesce(1) if pieces == 1 else mine.repartition(pieces)).write.mode("append").parquet(landed)
        for _ in range((k + 1) * pieces - _n_files(spark, rows.schema, landed)):  # of a range with fewer rows than pieces
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(landed)
    discard(spark, cut)
    return landed


def _n_files(spark: SparkSession, schema: T.StructType, folder: str) -> int:
    return len(spark.read.schema(schema).parquet(folder).inputFiles())


def per_range(spark: SparkSession, folder: str, files: int) -> int:
    """Files of each of the ``files`` ranges that ``land_in_order`` wrote to ``folder``."""
    return _n_files(spark, T.StructType(), folder) // files


def drain(stream: DataFrame, name: str, output_mode: str = "append", into: SparkSession | None = None) -> DataFrame:
    """Process all available input into parquet and return the result as a table."""
    return drain_and_report(stream, name, output_mode, into)[0]


def drain_and_report(
    stream: DataFrame, name: str, output_mode: str = "append", into: SparkSession | None = None
) -> tuple[DataFrame, list[tuple]]:
    """The drained table, and what each trigger read and kept, as PROGRESS states it."""
    spark = stream.sparkSession
    folder = fresh_folder(spark, name)
    run = (
        stream.writeStream.format("parquet").outputMode(output_mode)
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    report = []
    for p in run.recentProgress:
        states = p.stateOperators
        report.append((
            p.batchId, sum(s.numInputRows for s in p.sources), sum(s.numRowsTotal for s in states), sum(s.numRowsRemoved for s in states),
            sum(s.numRowsDroppedByWatermark for s in states), p.eventTime.get("watermark"),
        ))
    return (into or spark).read.schema(stream.schema).parquet(f"{folder}/rows"), report
