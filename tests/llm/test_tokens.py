"""Encoding against the tokenizer on whole texts, and the exact way back."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.TOKENIZERS, tokens.VOCABULARY).exists(), reason="no vocabulary files here")
TEXTS = [
    None, "", " ", "Hello  world\n\n it's 12,345 ok", "发电机组应每月检查一次。\t表格 | 3.5kV", "​🔌⚠️ ﻿x", "<|endoftext|>", "a" * 20_000, "的" * 30_000, "  lead and trail  \n", "don't DON'T 'll",
    "same", "same", "Ω≈ｆｕｌｌ　ｗｉｄｔｈ", "\r\n\r\n",
]


def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"doc": F.lit(1), "word": F.lit("w"), "block": F.lit(2), "ids": F.lit("i")})


def test_ids_equal_whole_text_encoding(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 40)
    whole = tokens._encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    encoded = tokens.encode_corpus(corpus(spark), "doc_id", "text")
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: whole.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(corpus(spark), "doc_id", "text").collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    back = {r.doc_id: r.text for r in tokens.decode_corpus(encoded, "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_null_and_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id is None, len(r.ids)) for r in tokens.encode_corpus(df, "doc_id", "text").collect()) == [(False, 1), (False, 1), (True, 2)]
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    empty = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert tokens.encode_corpus(empty, "doc_id", "text").first().ids == []


def test_decoding_keeps_repeated_rows_and_refuses_unknown_ids(spark):
    import pytest

    schema = "doc_id long, ids array<int>"
    rows = [(1, [0, 1]), (1, [0, 1]), (1, None), (None, []), (2, [5, None])]
    decoded = tokens.decode_corpus(spark.createDataFrame(rows, schema), "doc_id", "ids").collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in decoded) == [(0, 0), (1, 0), (1, 2), (1, 2), (2, 1)]
    with pytest.raises(Exception, match="no token has the id 99999999"):
        tokens.decode_corpus(spark.createDataFrame([(1, [99_999_999])], schema), "doc_id", "ids").collect()


def test_other_vocabulary(spark):
    name = "byte_bpe_multi_50k.tiktoken"
    whole = tokens._encoding(f"{tokens.TOKENIZERS}/{name}")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(corpus(spark), "doc_id", "text", vocabulary=name).collect()}
    assert got[4] == whole.encode_ordinary(TEXTS[4])
