"""The near-duplicate stage against plain all-pairs comparison of five-word shingle sets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from kinelex.llm import similar
from kinelex.llm.common import fields, numbered


def shingle_set(text: str | None) -> frozenset:
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def alike(a: frozenset, b: frozenset) -> bool:
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


def test_near_duplicates_are_those_of_similarity(spark):
    r = random.Random(8)
    texts: list[str | None] = [None, "", " \n", "One two", "one TWO", "one three"]
    for _ in range(15):
        ws = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 120))]
        texts.append(" ".join(ws))
        for changes in (1, 2, 3):
            more = list(ws)
            for i in r.sample(range(len(ws)), changes):
                more[i] = "changed"
            texts.append(" ".join(more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1))
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if alike(sets[a], sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(comp))
    assert similar.keep_first(docs.limit(0)).count() == 0


def test_members_of_a_group_without_a_common_leader(spark):
    """A chain: each text is similar to the next alone, so pairs beside the leaders count."""
    ws = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(ws[4 * i : 4 * i + 100])) for i in range(20)], "doc_id long, text string")
    assert len({x.component for x in similar.members(fields(numbered(docs), "text")).collect()}) == 1


def test_classes_of_operator_7_come_first_and_are_checked(spark, monkeypatch):
    """All texts in one class: each is held against its first, and only what is similar is linked."""
    ws = [f"w{i}" for i in range(200)]
    texts = [" ".join(ws), " ".join([*ws[:-1], "changed"]), " ".join(ws[::-1])]
    seen = []
    monkeypatch.setattr(similar.simhash, "placed", lambda fps: seen.append(fps.count()) or fps.select("id", "fp", F.lit(fps.agg(F.min("id")).first()[0]).alias("component_id")))
    docs = numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ids = {x.row: x.doc_id for x in fields(docs, "doc_id").collect()}
    groups: dict = {}
    for x in similar.members(fields(docs, "text")).collect():
        groups.setdefault(x.component, set()).add(ids[x.row])
    assert seen == [3] and sorted(map(sorted, groups.values())) == [[0, 1], [2]]
