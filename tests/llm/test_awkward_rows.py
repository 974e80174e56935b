"""Columns with the names of helpers, maps, dotted names, and ids near the ends of their range: values are compared."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from kinelex.llm import mixing, quality_rules, secret_scan, sharding, simhash, similar, suffix_dedup
from pyspark.sql import functions as F

BIG = 1 << 62
LETTERS = [f"w{k}" for k in range(400)]


def _text(i, n=80):
    r = random.Random(i)
    return "\n".join(" ".join(r.choices(LETTERS, k=20)) + "." for _ in range(n // 20))


#: id, text, source; each row comes with its number in columns of awkward names.
ROWS = [(BIG, _text(1), "a"), (BIG, _text(1), "a"), (BIG, _text(2), "b"), (-BIG, _text(3), None), (None, _text(4), "a"), (None, _text(4), "a"), ((1 << 63) - 1, _text(5), "b"), (-(1 << 63), None, "b"), (0, "", None), (1, _text(6, 4000), "c"), (2, "too short", "c")]
NAMES = ("row", "whole", "__row", "__copies", "copies", "epoch", "a.b", "n_words", "__words", "__h", "h", "copy", "size", "bucket", "component", "c0", "cleaned")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, source string, i int")
    df = df.select("doc_id", "text", "source", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *(F.concat(F.lit(f"{n}:"), "i").alias(n) for n in NAMES), F.create_map(F.lit("k"), F.col("i")).alias("map"))
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def _origin(row, columns=NAMES):
    """Number of the row that a kept row came from, after all of its columns have been looked at."""
    i = row["map"]["k"]
    assert all(row[n] == f"{n}:{i}" for n in columns) and (row["doc_id"], row["source"]) == (ROWS[i][0], ROWS[i][2])
    return i


@pytest.mark.parametrize("keep", [similar.keep_first, simhash.keep_first])
def test_one_of_each_group(docs, keep):
    out = keep(docs)
    assert out.columns == docs.columns and out.schema["map"].dataType == docs.schema["map"].dataType
    rows = out.collect()
    kept = {_origin(r) for r in rows}
    assert all(r["text"] == ROWS[_origin(r)][1] for r in rows) and len(rows) == len(kept)
    # rows 0 and 1, 4 and 5, and the texts without words are groups; the smallest id stays, null ids last
    assert len(kept & {0, 1}) == 1 and len(kept & {4, 5}) == 1 and 7 in kept and 8 not in kept and kept >= {2, 3, 6, 9, 10}


def test_mix(docs):
    taken = {}
    for r in mixing.mix(docs).collect():
        assert r["text"] == ROWS[_origin(r)][1]
        taken[_origin(r)] = taken.get(_origin(r), 0) + 1
    words = {i: len((t or "").split()) * taken.get(i, 0) for i, (_, t, _) in enumerate(ROWS)}
    for source in ("a", "b", "c", None):
        target = {x.target for x in mixing.plan(docs.select("doc_id", "text", "source")).where(F.col("source").eqNullSafe(F.lit(source))).collect()}
        sizes = [len((t or "").split()) for _, t, s in ROWS if s == source]
        assert len(target) == 1 and abs(sum(words[i] for i, r in enumerate(ROWS) if r[2] == source) - target.pop()) <= max(sizes) / 2 + 1e-9


def test_quality_and_secrets(docs):
    judged = {_origin(r, [n for n in NAMES if n not in quality_rules.FIGURES]): r for r in quality_rules.judge(docs).collect()}
    assert len(judged) == len(ROWS) and all(judged[i]["n_words"] == len((t or "").split()) for i, (_, t, _) in enumerate(ROWS))
    kept = quality_rules.keep_clean(docs)
    assert kept.columns == docs.columns and {_origin(r) for r in kept.collect()} == {i for i in judged if judged[i]["kept"]}
    forest = secret_scan.train(secret_scan.labelled_findings(docs.sparkSession))
    assert {_origin(r): r["text"] for r in secret_scan.redact(docs, forest).collect()} == {i: t for i, (_, t, _) in enumerate(ROWS)}


def test_shards(docs, monkeypatch):
    for small in (4 << 20, 8):
        out = sharding.shuffled(docs, shards=3, bucket_bytes=small)
        rows = out.collect()
        assert sorted(_origin(r) for r in rows) == list(range(len(ROWS))) and all(r["text"] == ROWS[_origin(r)][1] for r in rows)
        assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((p % 3, p // 3) for p in range(len(ROWS)))
        again = {(r["map"]["k"], r["shard"], r["slot"]) for r in sharding.shuffled(docs.repartition(5), shards=3, bucket_bytes=small).collect()}
        assert again == {(r["map"]["k"], r["shard"], r["slot"]) for r in rows}
    many = docs.where("map['k'] = 0").select("doc_id", "text", "map", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("n")).drop("n")
    assert sorted((r["shard"], r["slot"]) for r in sharding.shuffled(many, shards=3, bucket_bytes=8).collect()) == sorted((p % 3, p // 3) for p in range(500))


@pytest.mark.parametrize("ids", [(BIG, BIG, BIG - 1), ((1 << 63) - 1, (1 << 63) - 1, -(1 << 63)), (None, -(1 << 40), -(1 << 41)), (None, None, 5)])
def test_suffix_dedup_with_large_repeated_and_missing_ids(spark, ids):
    """The document first in the order of ids, null ids before all, keeps the string that all share."""
    texts = [f"{i} " * 5 + "the same hundred bytes " * 6 + f" {i}" for i in range(3)]
    out = suffix_dedup.deduplicate(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)).collect()
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = suffix_dedup.brute_force({i: t.encode() for i, (_, t) in enumerate(order)}, 100)
    assert sorted(str((x.doc_id, x.n_bytes, len(x.kept))) for x in out) == sorted(str((k, want[i][0], want[i][0] - want[i][1])) for i, (k, _) in enumerate(order))


def test_stages_of_the_pipeline(spark, docs):
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, "")
        assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(_origin(r) not in (7, 8, 10) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, got, "").count() == len(rows)
