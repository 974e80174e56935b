"""Spelling variants against their definition."""

import random
import re
import zlib
from collections import Counter

import pytest
from kinelex.llm import queries, spelling_variants
from pyspark.sql import functions as F


def _words(seed, letters, n, lengths):
    r = random.Random(seed)
    words = {"".join(r.choices(letters, k=r.choice(lengths))) for _ in range(n)}
    return {w: r.choice([1, 2, 3, 3, 6, 7, 14, 40]) for w in words}


@pytest.mark.parametrize("most", [1, 3, 512])
def test_against_definition(spark, most):
    """Few letters give cells that overflow, ties of frequency, forms of forms, repeated letters."""
    counted = _words(1, "abé", 260, (1, 2, 3, 4, 5, 6, 7)) | _words(2, "ab", 60, (8, 9)) | {"a" * 40: 3, "a" * 41: 6, "a" * 39 + "b": 12, "b": 5}
    words = spark.createDataFrame(list(counted.items()), "word string, n long").select("*", F.lit(1).alias("root")).repartition(5)
    got = sorted((tuple(x) for x in spelling_variants.variants(words, most=most).collect()), key=str)
    want = spelling_variants.brute_force(counted)
    assert got == sorted(want, key=str) and any(x[5] not in (x[0], x[3]) for x in want)


def test_no_pair_twice_and_shortest(spark):
    counted = _words(3, "abc", 300, (5, 6, 7))
    words = spark.createDataFrame(list(counted.items()), "word string, n long")
    got = [(x.a, x.b) for x in spelling_variants.near(words, shortest=5, most=20).collect()]
    want = {(a, b) for a in counted for b in counted if a < b and spelling_variants.one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_edit():
    for a, b, ok in (("", "a", True), ("a", "a", False), ("ab", "ba", False), ("ab", "b", True), ("abc", "axc", True), ("abc", "abcde", False), ("aab", "ab", True), ("é", "e", True)):
        assert spelling_variants.one_edit(a, b) == spelling_variants.one_edit(b, a) == ok


def test_query_on_whole_table(spark, tmp_path):
    r = random.Random(4)
    known = ["".join(r.choices("eiraéÀ", k=r.choice([4, 5, 6, 7]))) for _ in range(400)]
    rows = [(r.choice([i, 3, None]), r.choice(["Word ", "w0rd", " × ", "", "-"]).join(r.choices(known, k=120))) for i in range(60)] + [(1, None), (2, ""), (3, "123 _ ñandú ÑANDÚ ÑANDÚ " * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    n: Counter[str] = Counter()
    for k, t in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    want = spelling_variants.brute_force({w: c for w, c in n.items() if c >= 3 and len(w) >= 5})
    got = queries.op11_spelling_variants(spark, str(tmp_path)).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    words = spelling_variants.counts(spark.createDataFrame([(None, None)], "doc_id long, text string"))
    assert words.collect() == [] and spelling_variants.variants(words).collect() == []
