"""The pipeline: stages keep their columns, decisions take effect, the rest imports without it."""

import math
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, FOLDER), f"test-{name}")
        if name != "token_planes":
            assert out.columns == columns
            left = [r[0] for r in out.select("doc_id").collect()]
            assert set(left) <= ids and len(left) >= 0.4 * len(ids)
            if name != "mixing":
                assert len(left) == len(set(left))
            ids = set(left)
        else:
            assert out.count() == docs.count()
        docs = out
    assert docs.select(F.countDistinct("doc_id")).first()[0] == len(ids)


def test_mixing_decides_every_row_of_a_null_or_repeated_id(spark):
    """Most rows have no id, others share one: each has the copies its source is due, rounded, and the words stay at the target."""
    rows = [(None if k % 8 else k, f"n{k} " + "word " * (k % 5 + 1), "en", "b", k) for k in range(200)]
    rows += [(7, f"r{k} " + "word " * 3, "en", "b", k) for k in range(40)]
    rows += [(None, "same text here", "en", "b", 0)] * 40 + [(None, None, "en", "a", 0), (1000, "other " * 2600, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.mixing_stage(spark, docs, FOLDER)
    assert out.columns == docs.columns
    got, given = Counter(map(tuple, out.collect())), Counter(rows)
    size = lambda r: len((r[1] or "").split())
    targets = {r["source"]: r["target"] for r in corpus_pipeline.mixing.mix(docs).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        assert abs(sum(n * size(r) for r, n in got.items() if r[3] == source) - target) <= max(size(r) for r in given if r[3] == source)
    due = targets["b"] / sum(n * size(r) for r, n in given.items() if r[3] == "b")
    for r, n in given.items():
        if r[3] == "b" and r[1] != "same text here":
            assert math.floor(due) <= got[r] <= math.ceil(due)
