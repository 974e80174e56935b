"""Alignment of two tokenizers against its definition."""

import hashlib

import public_tokenizers
import pytest
from kinelex.llm import token_alignment
from pyspark.sql import functions as F

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  two  spaces ", "plain words, and more words.", "plain words, and more words.", "naïve Ünïcode — 漢字 \U0001f600 ok", "a\nb\n\nc\t\r\n", "</s>[INST] <|endoftext|> <s> <unk> <0x41>",
    "under▁score", "x" * 300, "\x00\x01 odd", "1234567 89", " word " * 500,
]


def test_against_definition(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("key"), F.lit(2).alias("a.b")).repartition(3)
    want = sorted(((k, *x) for (k, _), x in zip(rows, token_alignment.brute_force(TEXTS, token_alignment.load(A), token_alignment.load(B)), strict=True)), key=str)
    assert sorted((tuple(r) for r in token_alignment.align(docs, A, B).collect()), key=str) == want
    digests = sorted((r["groups"] for r in token_alignment.align(docs, A, B, digest=True).collect()))
    assert digests == sorted(hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for x in want)


def test_blocks_make_no_difference(spark, monkeypatch):
    texts = [f"common words and {i % 7} rare ones {'again ' * (i % 4)}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = [(i, *x) for i, x in enumerate(token_alignment.brute_force(texts, token_alignment.load(A), token_alignment.load(B)))]
    assert sorted(tuple(r) for r in token_alignment.align(docs, A, B).collect()) == want


def test_byte_level_ids_are_the_librarys_own():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    texts = [t for t in TEXTS if t] + [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)} {chr(c)}x \n{chr(c)}" for c in range(0, 0x3000, 7)]
    assert token_alignment.load(A).encode(texts) == [x.ids for x in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@pytest.mark.parametrize("ends_a,ends_b", [([2, 5, 6], [1, 2, 6]), ([3], [1, 2, 3]), ([1, 2], [1, 2])])
def test_overlaps(ends_a, ends_b):
    import numpy as np

    a, b = np.array(ends_a), np.array(ends_b)
    ia, ib = token_alignment.overlaps(a, np.diff(a, prepend=0), b)
    start = lambda e, i: e[i - 1] if i else 0
    assert list(zip(ia.tolist(), ib.tolist(), strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if start(a, i) < b[j] and start(b, j) < a[i]]
