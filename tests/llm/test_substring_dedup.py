"""Removal of repeated word passages against its definition."""

import hashlib
import random

import pytest
from kinelex.llm import queries, substring_dedup
from pyspark.sql import functions as F

MAX = (1 << 63) - 1


def _rows(seed):
    """Documents that share passages, copies, repeated and null ids, ties, awkward texts."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "ab", "ç", "x.", "Word", f"w{r.randrange(40)}"])
    passages = [[word() for _ in range(r.randrange(5, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randrange(0, 25))] for _ in range(r.randrange(0, 5))]
        rows.append((r.choice([i, i, 7, None, MAX, -MAX, 1 << 62]), r.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    rows += [(3, None), (4, ""), (5, "  \n"), (6, "a " * 400), (7, "a " * 400), (8, "a " * 23), (9, "b a " * 150), (10, "b a " * 150), (10, "b a " * 150), (11, " ".join("abc" * 9))]
    return rows + rows[:5] + [(100 + i, rows[0][1]) for i in range(5)]


def _asked(df):
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return sorted((tuple(x) for x in df.select("doc_id", "n_words", lost, "longest", F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize("length", [2, 7, 16])
def test_against_definition(spark, length):
    rows = _rows(length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("ord"), F.lit(2).alias("a.b")).repartition(4)
    want = substring_dedup.brute_force([(k, None if t is None else t.encode()) for k, t in rows], length)
    assert any(x[2] for x in want) and any(x[3] > 2 * length for x in want)
    assert _asked(substring_dedup.deduplicate(docs, length)) == sorted(want, key=str)
    once = [(k, n, lost, length * (x > 0), h) for k, n, lost, x, h in want]
    assert _asked(substring_dedup.deduplicate(docs, length, doubling=False)) == sorted(once, key=str)


def test_slices_make_no_difference(spark, monkeypatch):
    import numpy as np

    r = random.Random(5)
    words = [np.array([r.randrange(9) for _ in range(n)], np.uint64) for n in (0, 3, 700, 40, 5000)]
    whole = lambda: sorted((int(which[p]), int(q - ([0, *ends][p]) + first[p]), int(h)) for w, ends, which, first in substring_dedup.slices(words, 10) for q, _, h in zip(*substring_dedup.anchored(w, ends, 10), strict=True) for p in [int(np.searchsorted(ends, q, "right"))])
    want = whole()
    monkeypatch.setattr(substring_dedup, "SLICE", 64)
    assert whole() == want and len(want) == sum(max(0, len(w) - 9) for w in words)


def test_query_on_whole_table(spark, tmp_path):
    """Passages of 50 words and more among documents, as the query takes them."""
    r = random.Random(1)
    new = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared, long_ = new(50), new(900)
    texts = [new(80) + shared + new(10), shared + new(70), new(30) + shared[:49], shared[1:] + new(60), long_, new(5) + long_[100:] + new(5), long_, new(200), shared + shared]
    rows = [(900 - i, " ".join(t)) for i, t in enumerate(texts)] + [(1, None), (None, " ".join(shared))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in queries.op13_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "longest", "kept_sha256").collect()), key=str)
    assert got == sorted(substring_dedup.brute_force([(k, None if t is None else t.encode()) for k, t in rows], 50), key=str)


def test_empty_table_and_spans(spark):
    assert substring_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d y d e")], "doc_id long, text string")
    got = {x.doc_id: x for x in substring_dedup.deduplicate(docs, 2).collect()}
    assert [tuple(s) for s in got[2].spans] == [(1, 5), (6, 8)] and bytes(got[2].kept) == b"x y" and got[2].longest == 4 and not got[1].spans
    assert hashlib.sha256(bytes(got[1].kept)).hexdigest() == hashlib.sha256(b"a b c d e").hexdigest()
