import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm.token_counts import DEFAULT_VOCABULARY, count_tokens, counter

PATH = public_tokenizers.path(DEFAULT_VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \n b", "\t\x0b\x0c\x1c x\x85y\xa0 z", "I'm we'll 's'd 'T", "1234 5६ ²", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext", "日本語 текст emoji 👩‍👩‍👧", "a࢏ b\U00010940\U00010940c ՘!", "᠎​ 　x", "=" * 3000, "ab" * 20_000, "0123456789" * 500, "\x00\x01 \x7f", "é" * 40, "﻿start"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert counter(PATH).count(text) == by_library(text)


def test_random_texts():
    rng = random.Random(8)
    letters = "abcXYZ019 \n\t'.,-_éßñ日👍  \x1f՘" + "  "
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert counter(PATH).count(text) == by_library(text), repr(text)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: (len(r.text.encode()), by_library(r.text)) for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs).collect()}
    assert got == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "two words", 6), (1, None, 5), (2, "x " * 5000, 7)], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in count_tokens(df).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 9, 2, False), (2, 10000, by_library("x " * 5000), True)], key=str)
    assert count_tokens(df.limit(0)).count() == 0
