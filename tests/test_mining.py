"""Mining against plain readings of the rules, on graphs and vectors that the tables don't hold."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from kinelex.operators import blocks, metrics, mining


def drawn(site, *keys, seed=0):
    return int(hashlib.md5("|".join([str(seed), site, *map(str, keys)]).encode()).hexdigest()[:8], 16) / 2**32


def one_by_one(pairs):
    """Every b in turn, as the rule says it."""
    uses, choices = {}, {}
    for a, b in pairs:
        uses[a] = uses.get(a, 0) + 1
        choices.setdefault(b, []).append(a)
    left, order, one_way = sorted(choices), [], 0
    while left:
        b = left.pop(0)
        best = lambda xs: min(xs, key=lambda a: (-math.log(1 - drawn("annotate", b, a)) * uses[a], a))  # noqa: B023, E731
        both = [a for a in choices[b] if a in left]
        if both:
            a = best(both)
            order += [(b, a, True, 0), (a, b, True, 1)]
            left.remove(a)
        else:
            order.append((b, best(choices[b]), False, 0))
            one_way += 1
    return [(*x, i) for i, x in enumerate(order)], one_way


@pytest.mark.parametrize("kind", ["sparse", "dense", "chain", "star", "empty"])
def test_annotation_order(spark, kind):
    r = random.Random(kind)
    pairs = {
        "sparse": {(r.randrange(60), r.randrange(60)) for _ in range(90)},
        "dense": {(r.randrange(25), r.randrange(25)) for _ in range(400)},
        "chain": {(i + 1, i) for i in range(40)} | {(i, i + 1) for i in range(40)},
        "star": {(99, i) for i in range(30)} | {(i, 99) for i in range(30)} | {(i, i + 1) for i in range(20)},
        "empty": set(),
    }[kind]
    pairs = {(a, b) for a, b in pairs if a != b}
    df = spark.createDataFrame(sorted(pairs), "a long, b long").repartition(4)
    got = sorted((tuple(x) for x in mining.annotation_order(df).collect()), key=lambda x: x[-1])
    want, one_way = one_by_one(pairs)
    assert got == want and sum(not x[2] for x in got) == one_way


def test_annotation_order_takes_few_rounds(spark, monkeypatch):
    """Where every pose can be taken by all before it, settling one of them a round took as many rounds as there are pairs asked both ways."""
    pairs = {(a, b) for a in range(60) for b in range(60) if a != b}
    rounds = []
    plain = mining.stored
    monkeypatch.setattr(mining, "stored", lambda df, what: rounds.append(what) or plain(df, what))
    got = sorted((tuple(x) for x in mining.annotation_order(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()), key=lambda x: x[-1])
    assert got == one_by_one(pairs)[0] and rounds.count("taken") < 20


@pytest.mark.parametrize("rows", [3, 1000])
def test_blocks_give_what_the_whole_matrix_gives(spark, rows):
    """More than one block, ties, equal vectors, and values that must differ with nulls among them."""
    g = np.random.default_rng(3)
    v = g.normal(size=(40, 5))
    v[7] = v[8] = v[30]
    v /= np.linalg.norm(v, axis=1)[:, None]
    group = [None if i % 9 == 0 else i % 3 for i in range(40)]
    df = spark.createDataFrame([(i * 10, [float(x) for x in v[i]], group[i]) for i in range(40)], "id long, v array<double>, label int").repartition(3)
    s = np.round(v @ v.T, 6) + 0.0
    want = set()
    for b in range(40):
        others = sorted((a for a in range(40) if a != b and (group[a] is None or group[b] is None or group[a] != group[b])), key=lambda a: (-s[b, a], a))
        want |= {(b * 10, a * 10, float(s[b, a]), n + 1) for n, a in enumerate(others[:4])}
    assert {tuple(x) for x in blocks.most_similar(df, 4, "label", rows).collect()} == want
    targets = spark.createDataFrame([(i * 10, [float(x) for x in v[(i + i % 2) % 40]]) for i in range(40)], "id long, v array<double>")
    t = np.array([v[(i + i % 2) % 40] for i in range(40)])
    s = np.round(v @ t.T, 9)
    ranks = {i * 10: int(sum(s[i, j] > s[i, i] or (s[i, j] == s[i, i] and j < i) for j in range(40))) for i in range(40)}
    assert {x["id"]: x["rank"] for x in metrics.ranks(df, targets, rows=rows).collect()} == ranks
