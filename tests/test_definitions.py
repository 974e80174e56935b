"""Operators against small cases worked out by hand or by plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kinelex.operators import dataset, metrics, mining, text
from kinelex.plans import catalog


def test_catalogue_counts_and_supports():
    """Counted definitions: 271 codes with 150 super-codes, 49 pair codes with 52; rare supports are of type 2, all supports are accepted."""
    assert (len(catalog.CODES), len(catalog.SUPERS), len(catalog.PAIR_CODES), len(catalog.SUPER_PAIRS)) == (271, 150, 49, 52)
    assert len({(c.kind, c.joints) for c in catalog.CODES}) == len(catalog.CODES)
    for c in catalog.CODES:
        types = dict(c.support)
        assert set(types) <= set(c.accepted) and all(types.get(x, 2) == 2 for x in c.rare), c
    near = {(s, t): dict(c.support).get("close") for c in catalog.CODES if c.kind == "distance" and c.rare == ("close",) for s, t in [c.joints]}
    assert near["left_hand", "right_shoulder"] == near["right_hand", "left_knee"] == 2


def test_flips(spark):
    cases = {
        "turn to the right": "turn to the left", "your right arm is at a right angle": "your left arm is at a right angle", "look at the right behind you": "look at the left behind you",
        "rotate clockwise, right-hand up": "rotate counterclockwise , left-hand up", "twist anticlockwise": "twist clockwise", "move the left hand rightwards": "move the right hand leftwards",
        "they are right there with the right elbow bent": "they are right there with the left elbow bent", "nothing to swap": "nothing to swap", "turn the left leg at two o'clock to the right": None,
    }
    df = spark.createDataFrame([(x,) for x in cases], "x string").withColumn("ts", text.tokens(F.col("x")))
    assert {r.x: r.y for r in df.select("x", F.array_join(text.flip(F.col("ts")), " ").alias("y")).collect()} == cases


def test_label_buckets(spark):
    frames = spark.createDataFrame([(i, s) for i, s in enumerate("nmabcd")], "frame_id int, sequence string")
    known = spark.createDataFrame([("m", "__ball__"), *((s, None) for s in "abcd")], "sequence string, marker string")
    labels = spark.createDataFrame([(3, None), (3, "x"), (4, "x"), (5, "x"), (5, "y")], "frame_id int, label string")
    got = {r.bucket: r.frames for r in dataset.label_histogram(labels, frames, known).collect()}
    assert got == {"none": 1, "__ball__": 1, "0 labels": 1, "null label": 1, "1 label": 1, ">1 labels": 1}


def test_rouge(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(2)
    rows = [(i, [r.choice("abc") for _ in range(r.randint(0, 7))], [r.choice("abc") for _ in range(r.randint(0, 7))]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = {x.i: x.s for x in df.select("i", metrics.rouge_l(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(math.isclose(got[i], 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0) for i, a, b in rows)


def test_frechet(spark):
    x = np.random.default_rng(4).standard_normal((300, 3))
    rows = [(1, v.tolist()) for v in x] + [(2, v.tolist()) for v in x] + [(3, (v + 2).tolist()) for v in x]
    f = spark.createDataFrame(rows, "label int, v array<double>")
    assert abs(metrics.frechet(f, "label", 1, 2)) < 1e-6 and abs(metrics.frechet(f, "label", 1, 3) - 12) < 1e-6


def test_farthest_can_go_on(spark):
    r = np.random.default_rng(5)
    points = {i: r.standard_normal((2, 3)) for i in range(30)}
    poses = spark.createDataFrame([(i, [tuple(map(float, p)) for p in ps]) for i, ps in points.items()], "pose_id long, joints array<struct<x:double,y:double,z:double>>")
    picked = [0]
    while len(picked) < 6:
        gap = {i: min(np.linalg.norm(points[i] - points[j], axis=1).mean() for j in picked) for i in points if i not in picked}
        picked.append(max(gap, key=lambda i: (gap[i], -i)))
    first = mining.farthest(poses, 3)
    assert [x.pose_id for x in mining.farthest(poses, 6, first).orderBy("rank").collect()] == picked


def test_formatted_metrics(spark):
    rows = [("mpje", 0.2018), ("bleu", 0.339), ("recall_1", 47.9166), ("fid", 0.12345)]
    got = {r.metric: r.text for r in metrics.formatted(spark.createDataFrame(rows, "metric string, value double")).collect()}
    assert got == {"mpje": "202", "bleu": "33.90", "recall_1": "47.92", "fid": "0.123"}
