"""Registered queries of this subpackage: the contract's digests of each operator's results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontaminate, extract, merkle, mixing, ngrams, quality, secrets, tokens, topk, toxicity, urls, whitening
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(table(spark, folder, "documents"))


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.jaccard_join(table(spark, folder, "documents"), width=4, num=85, den=100)


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, folder, "embeddings"), threshold=0.93)


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality.classify(documents, quality.train(documents, table(spark, folder, "labels")))


def op7_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.digest(table(spark, folder, "documents"), tokenizer_path())


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.classify(documents, toxicity.train(documents, table(spark, folder, "labels")))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


def op13_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), k=10, scale=1024, every=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [
        op1_secrets, op2_ngram_jaccard, op3_embedding_near_dedup, op4_source_mixing, op5_url_filters, op6_quality, op7_token_planes,
        op8_toxicity, op9_html_extraction, op10_decontamination, op11_whitening, op12_merkle_manifest, op13_top_k,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_top_k": topk.ORACLE}
