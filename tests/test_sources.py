"""Sequences, batches and cached tables."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelex.sources import maps, motion
from kinelex.sources.batches import batches, collated
from kinelex.sources.cache import Cache, fingerprint


def matrix(v):
    n = float(np.linalg.norm(v))
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / (n or 1)
    return np.eye(3) + math.sin(n) * k + (1 - math.cos(n)) * k @ k


@pytest.fixture
def sequences(tmp_path):
    g = np.random.default_rng(1)
    made = {}
    for name, n in (("a/one", 40), ("a/two", 7), ("three", 1)):
        made[name] = g.normal(size=(n, 12))
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (np.savez_compressed if n == 7 else np.savez)(tmp_path / f"{name}.npz", poses=made[name].astype(np.float32) if n == 7 else made[name], mocap_framerate=100.0 + n)
    return str(tmp_path), made


def test_only_asked_frames_are_decoded(spark, sequences):
    path, made = sequences
    rows = [(1, "a/one", 3), (2, "a/one", 39), (3, "a/one", 3), (4, "a/two", 6), (5, "a/two", 7), (6, "none", 0), (7, "a/one", -1), (None, "three", 0)]
    wanted = spark.createDataFrame(rows, "pose_id long, sequence string, frame int")
    got = {(r.pose_id, r.sequence, r.frame): r for r in motion.read_frames(spark, path, wanted).collect()}
    assert set(got) == set(rows)
    for (_, name, frame), r in got.items():
        there = name in made and 0 <= frame < len(made[name])
        assert (r.rotvecs is not None) == there and r.fps == (100.0 + len(made[name]) if name in made else None)
        if there:
            np.testing.assert_allclose(np.array([tuple(p) for p in r.rotvecs]).ravel(), made[name][frame], rtol=1e-6)
        assert r.n_read == {"a/one": 2, "a/two": 1, "three": 1, "none": 0}[name]


def test_normalised_orientation(spark, sequences):
    path, made = sequences
    wanted = spark.createDataFrame([(i, "a/one", i) for i in range(40)], "pose_id long, sequence string, frame int")
    poses = motion.read_frames(spark, path, wanted)
    out = poses.select("pose_id", "rotvecs", motion.normalized(F.col("rotvecs")).alias("n"))
    out = out.select("*", motion.normalized(F.col("rotvecs"), F.col("n.turn")).alias("again"))
    for r in out.collect():
        before, after, turn = (matrix(np.array(tuple(x))) for x in (r.rotvecs[0], r.n.rotvecs[0], r.n.turn))
        np.testing.assert_allclose(after, turn @ before, atol=1e-9)
        assert abs(math.atan2(after[1, 0], after[0, 0])) < 1e-9, "no heading is left"
        assert math.isclose(math.atan2(after[2, 1], after[2, 2]), math.atan2(before[2, 1], before[2, 2]), abs_tol=1e-9)
        assert r.n.rotvecs[1:] == r.rotvecs[1:]
        np.testing.assert_allclose(matrix(np.array(tuple(r.again.rotvecs[0]))), after, atol=1e-9)


def test_batches(spark):
    rows = [(i, f"t{i}") for i in range(103)] + [(7, "t7")] * 3 + [(None, None)] * 2
    df = spark.createDataFrame(rows, "id long, text string").select("*", F.lit("x").alias("a.b"), F.create_map(F.lit("k"), "id").alias("m"))
    one = [tuple(r)[:2] + (r.batch, r.slot) for r in batches(df.repartition(3), ["id"], 10, epoch=2).orderBy("batch", "slot").collect()]
    assert one == [tuple(r)[:2] + (r.batch, r.slot) for r in batches(df.repartition(7), ["id"], 10, epoch=2).orderBy("batch", "slot").collect()]
    assert sorted(map(str, (x[:2] for x in one))) == sorted(map(str, rows)) and [x[2:] for x in one] == [(i // 10, i % 10) for i in range(108)]
    assert [x[0] for x in one] != [r.id for r in batches(df, ["id"], 10, epoch=3).orderBy("batch", "slot").collect()]
    rest = [tuple(r)[:2] + (r.batch, r.slot) for r in batches(df, ["id"], 10, epoch=2, drop_last=True, start=4).orderBy("batch", "slot").collect()]
    assert rest == [x for x in one if 4 <= x[2] < 10]
    held = {r.batch: (r.n, r.id) for r in collated(batches(df, ["id"], 10, epoch=2), "id", "text").collect()}
    assert held == {b: (len(xs), xs) for b in range(11) for xs in [[x[0] for x in one if x[2] == b]]}
    assert batches(df.limit(0), ["id"], 10, drop_last=True).count() == 0


def test_cache(spark, tmp_path):
    cache, runs = Cache(spark, str(tmp_path)), []
    df = spark.range(50).select("id", F.create_map(F.lit("k"), "id").alias("m"))

    def build(tag):
        return lambda: runs.append(tag) or df.select("id", F.lit(tag).alias("tag"))

    ask = lambda tag, params, d=df: {r.tag for r in cache.get("items", {"poses": d}, params, build(tag)).collect()}
    assert ask("first", {"split": "val", "tokens": "bpe"}) == {"first"} == ask("second", {"split": "val", "tokens": "bpe"}, df.repartition(9))
    assert ask("third", {"split": "test", "tokens": "bpe"}) == {"third"} and ask("fourth", {"split": "val", "tokens": None}) == {"first"}
    assert ask("fifth", {"split": "train", "tokens": None}) == {"fifth"}
    assert ask("sixth", {"split": "val", "tokens": "bpe"}, df.where("id <> 3")) == {"sixth"} and runs == ["first", "third", "fifth", "sixth"]
    # a table without a manifest was broken off
    df.write.parquet(f"{tmp_path}/broken/table-0")
    (tmp_path / "broken" / "table-0.part").write_text(json.dumps({"inputs": {}, "params": {}, "path": f"{tmp_path}/broken/table-0"}))
    assert {r.tag for r in cache.get("broken", {}, {}, build("whole")).collect()} == {"whole"}
    with pytest.raises(ZeroDivisionError):
        cache.get("failed", {}, {}, lambda: 1 // 0)
    assert {r.tag for r in cache.get("failed", {}, {}, build("later")).collect()} == {"later"}


def test_fingerprint_sees_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    assert fingerprint(a) == fingerprint(a.orderBy(F.desc("id")).repartition(5)) != fingerprint(a.union(a)) != fingerprint(a.withColumnRenamed("t", "u"))


def test_maps(spark, tmp_path):
    (tmp_path / "texts.json").write_text(json.dumps({"1": "one", "2": ["two", "zwei"]}))
    assert sorted(map(tuple, maps.read_texts(spark, str(tmp_path / "texts.json")).collect())) == [(1, 0, "one"), (2, 0, "two"), (2, 1, "zwei")]
    maps.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert maps.stage(spark.range(4), spark, str(tmp_path / "stage")).count() == 4 == maps.stage(spark.range(9), spark, str(tmp_path / "stage")).count()
