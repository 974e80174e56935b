"""Connected components against union-find, and what they and stored tables leave on the disk."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from kinelex.llm.common import stored
from kinelex.llm.components import components

R = random.Random(5)
GRAPHS = {
    "empty": [],
    "nothing said": [(1, 1), (None, 2), (3, None)],
    "chain": [(i, i + 1) for i in range(40)],
    "star": [(0, i) for i in range(1, 50)],
    "star about its largest": [(100, i) for i in range(50)],
    "random": [(R.randrange(300), R.randrange(300)) for _ in range(250)],
    "cycle and repeats": [(-5, 3), (3, 9), (9, -5), (3, 9), (20, 21)],
}


def least_reachable(links: list) -> dict:
    at: dict = {}

    def first(x: int) -> int:
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((first(at.setdefault(a, a)), first(at.setdefault(b, b))))
            at[y] = x
    return {x: first(x) for x in at}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_are_those_of_union_find(spark, name):
    got = components(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()
    assert len(got) == len({x.node for x in got}) and {x.node: x.component for x in got} == least_reachable(GRAPHS[name])


def test_a_star_is_seen_as_one_without_a_further_round(spark):
    """Each task leaves files and events, so where partitions aren't joined the number of tasks counts."""
    n, held = 60, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sc, group = spark.sparkContext, "a star"
    links = stored(spark.createDataFrame(GRAPHS["star"], "a long, b long"), "links")
    sc.setJobGroup(group, group)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert components(links).count() == 50
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert 0 < sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s))) < 6 * n


def test_what_a_stored_table_shuffled_is_freed(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in str(disk.getAllFiles().mkString(" ")).split() if "/shuffle_" in x}
    before = shuffled()
    assert len(stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "freed").collect()) == 700
    end = time.time() + 10
    while (left := shuffled() - before) and time.time() < end:
        time.sleep(0.5)
    assert not left
