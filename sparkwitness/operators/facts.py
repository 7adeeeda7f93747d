"""Reuse of extracted facts by content identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["namespace", "content_id"]


def cached_facts(inputs: DataFrame, fact_store: DataFrame) -> DataFrame:
    """Inputs whose content is in the store, with the stored facts."""
    return inputs.join(fact_store, KEY)


def facts_to_extract(inputs: DataFrame, fact_store: DataFrame) -> DataFrame:
    """Inputs that need extraction: unknown content, or no content identity at all."""
    return inputs.join(fact_store.select(*KEY).distinct(), KEY, "left_anti")


def reuse_counters(inputs: DataFrame, fact_store: DataFrame) -> DataFrame:
    known = fact_store.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return (
        inputs.join(known, KEY, "left")
        .groupBy("namespace")
        .agg(F.count_if(hit).alias("cache_hits"), F.count_if(~hit).alias("parsed_files"))
    )


def append_facts(new_facts: DataFrame, path: str) -> None:
    """Extracted facts go to the store as an append; rows without identity are not kept."""
    new_facts.where(F.col("content_id").isNotNull()).write.mode("append").partitionBy("namespace").parquet(path)
