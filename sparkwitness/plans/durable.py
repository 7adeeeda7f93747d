"""Cutting lineage so that lost executors do not replay everything."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where a local run names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for plans that read it more than once."""
    return kept_for(df, name, df.sparkSession)[0]


def kept_for(df: DataFrame, name: str, *sessions: SparkSession) -> list[DataFrame]:
    """``df`` written once to the shared folder, as a table of each of the sessions."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return [session.read.schema(df.schema).parquet(folder) for session in sessions]


def releasing(spark: SparkSession) -> SparkSession:
    """A session beside the given one, with its settings, that deletes a query's shuffle files once it has run; the given one is not altered."""
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) or not key.startswith("spark."):  # settings of Spark, and of the stores it reads
            beside.conf.set(key, value)
    beside.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return beside


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``fresh_folder`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
