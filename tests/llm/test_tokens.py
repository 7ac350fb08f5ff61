import pytest

from gristmill.llm import tokens

SCHEMA = "doc_id bigint, text string"


def test_nulls_empty_repeats_long_and_clashing(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ids", "2 as n_tokens", "'z' as `__text`")
    got = tokens.encode_tokens(df)
    assert got.columns == ["doc_id", "ids"]
    by = sorted(((r.doc_id, len(r.ids)) for r in got.collect()), key=str)
    assert by == sorted([(1, 0), (2, 0), (3, 2), (3, 2), (None, 1), (4, 300_001)], key=str)
    counts = sorted(((r.doc_id, r.n_tokens) for r in tokens.count_tokens(df).collect()), key=str)
    assert counts == by
    assert tokens.encode_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.encode_tokens(df, keep=["doc_id", "ids"])
    assert tokens.encode_tokens(df, keep=["doc_id", "text"], out="t").columns == ["doc_id", "text", "t"]


def test_round_trip(spark, data):
    from gristmill.llm import bpe

    b = bpe.load(bpe.default_path())
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in docs.select("doc_id", "text").join(tokens.encode_tokens(docs), "doc_id").collect():
        assert b"".join(b.tokens[i] for i in r.ids).decode() == (r.text or "")
