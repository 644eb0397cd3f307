import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandframe.llm.tokenizer import Encoder, token_count, token_ids, vocabulary_path

ENCODER = Encoder(open(vocabulary_path(), "rb").read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    assert ENCODER.encode(text) == library(text)


def test_long_parts(library):
    rng = random.Random(2)
    for text in ("a" * 5000, "".join(rng.choice("abé") for _ in range(3000)), "\n" * 3000, " " * 999 + "x", "12" * 2000, "🙂" * 700):
        assert ENCODER.encode(text) == library(text)


def test_columns(spark, library):
    texts = ["", None, " ", "<|endoftext|> x", "It's 'll", "\r\n\t", "Größe été 你好", "x" * 4000, "same", "same", "\x00﻿"]
    df = spark.createDataFrame([(i, x, "ids") for i, x in enumerate(texts)], "doc_id int, text string, ids string")
    rows = df.select("doc_id", token_ids(spark, "text").alias("got"), token_count(spark, "text").alias("n")).collect()
    assert {r.doc_id: r.got for r in rows} == {i: library(x or "") for i, x in enumerate(texts)}
    assert all(r.n == len(r.got) for r in rows)
    assert df.limit(0).select(token_ids(spark, "text")).count() == 0
