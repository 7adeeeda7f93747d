"""Tests of the findings in FINDINGS_r03.md."""

from sparkwitness.llm import tokens
from sparkwitness.llm.registry import tokenizer_path


def test_token_ids_meet_their_starts_without_a_shuffle(spark, tmp_path):
    folder = str(tmp_path / "planes")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    tokens.write(docs, folder, tokenizer_path(), partitions=3)
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as for a container of any size
    try:
        found = tokens.read_documents(spark, folder)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(shard" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert found.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def test_encoder_keeps_words_of_plain_pieces_alone():
    import re

    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    plain = [chr(c) for c in range(0x250) if not re.match(tokens.NOT_PLAIN, chr(c))]
    texts = [a + b + a for a in plain for b in ("", "x", "7", ".", "É")] + ["it's.'S 'x''t9's", "Mr.Smith,22 \n  42nd", "", " \n "]
    encoder = tokens.Encoder(tokenizer_path())
    got = [ids.tolist() for ids in encoder.batch(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not encoder.pieces and encoder.words  # a piece costs no Python object of its own
