"""Stages that keep rows keep them by row, not by an id that may repeat or be null."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinelex.llm import mixing, simhash, similar


@pytest.mark.parametrize("module", [simhash, similar])
def test_one_row_of_each_component(spark, module):
    a, b, c = (" ".join(random.Random(i).choices([f"w{k}" for k in range(500)], k=80)) for i in range(3))
    rows = [(1, a), (1, a), (1, a), (1, b), (2, b), (None, a), (None, c), (None, c), (3, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = module.keep_first(docs)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (1, b), (None, c)])


@pytest.mark.parametrize("run", [1, 3, 4096])
def test_runs_of_ranges_make_no_difference(spark, monkeypatch, run):
    rows = [(i, "one two three " * (i % 5), "a" if i % 3 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.doc_id: r.taken for r in mixing.plan(docs).collect()}
    monkeypatch.setattr(mixing, "RUN", run)
    assert {r.doc_id: r.taken for r in mixing.plan(docs, range_docs=7).collect()} == want


def test_mix_takes_each_row_by_itself(spark):
    rows = [(7, "one two three", "a")] * 40 + [(None, "one two three", "a")] * 40 + [(i, "x y", "b") for i in range(100, 140)] + [(9, "z", None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.plan(docs)
    want = {(r.doc_id, r.source): r.n for r in plan.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect() if r.n}
    assert any(r.lo != r.hi for r in plan.groupBy("doc_id", "source").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()), "the cut lies between repeated rows"
    assert Counter((r.doc_id, r.source) for r in mixing.mix(docs).collect()) == want
