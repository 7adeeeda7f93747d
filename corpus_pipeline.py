"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwitness.llm import decontaminate, mixing, ngrams, tokens, toxicity
from sparkwitness.llm.common import private, stored, table
from sparkwitness.llm.registry import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; the grammar learns from the labelled rows of its own input."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8 or more, the smallest id stays.

    Rows that share their id are one document; rows with a null id stay.
    """
    found = ngrams.jaccard_join(docs, width=5, num=80, den=100)
    stays = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # The join leaves rows together by id, so numbering rows of one id moves nothing more.
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    number, = private("number")
    kept = docs.join(stays, "doc_id", "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; rows taken 0 times go.

    Each row is decided on its own, also under a null or repeated id; rows equal in all columns share their copies.
    """
    key, take, rows, time = private("key", "take", "rows", "time")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(*columns, *[c.isNull() for c in columns]))  # nulls alone would not be hashed
    mixed = mixing.mix(keyed, key=key).groupBy("doc_id", key).agg(F.sum("copies").alias(take), F.count("*").alias(rows))
    mixed = stored(mixed.where(F.col(take) > 0).withColumnRenamed("doc_id", "_id"), "mixing-taken")
    joined = keyed.join(mixed.withColumnRenamed(key, "_key"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_key")))
    alone = joined.where(F.col(rows) == 1).select(*columns, take)
    equal = joined.where(F.col(rows) > 1).select(*columns, take).distinct()  # one row stands for all of them
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(take))).alias(time)
    return alone.unionByName(equal).select(*columns, times).select(*columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The container's digest: (doc_id, start, n_tokens, ids_crc32) per row that the mix took."""
    return tokens.digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_planes", token_stage),
]

#: SQL cannot express learned grammars, walks or tokenizers; tests check the stages' columns and ids; open: brute-force rows per stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
