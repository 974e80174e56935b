"""What is broadcast, stored or shuffled stays bounded."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from kinelex.functions import stages
from kinelex.llm import common
from kinelex.operators import codes
from kinelex.plans import catalog, text_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stored", [stages.stored, common.stored])
def test_a_long_table_in_small_files_is_not_broadcast_unasked(spark, stored):
    wide = stored(spark.range(stages.FEW + 1).select(F.lit(7).alias("a"), F.lit(1).alias("b")), "long")
    other = stored(spark.range(50_000).select(F.lit(7).alias("a"), F.lit(2).alias("c")), "other")
    assert "Broadcast" not in plan(wide.join(other, "a")) and "Broadcast" not in plan(other.join(wide.groupBy("a").agg(F.max("b")), "a", "left_anti"))
    few = stored(spark.range(5).select(F.lit(7).alias("a")), "few")
    assert "Broadcast" in plan(few.join(spark.range(10).select(F.col("id").cast("int").alias("a")), "a"))
    assert "Broadcast" in plan(other.join(F.broadcast(wide), "a")), "what is asked for is done"


@pytest.mark.parametrize("query", ["describe", "instruct"])
def test_no_plan_of_a_text_is_large(spark, monkeypatch, query):
    """Plans, not rows, are what fills the driver here: in one, dozens of exchanges and their threads are held together."""
    sizes, plain = [], stages.written
    monkeypatch.setattr(stages, "written", lambda df, path: sizes.append(plan(df).count("Exchange")) or plain(df, path))
    getattr(text_queries, query)(spark, SF_DIR)
    assert len(sizes) > 8 and max(sizes) <= 24, sizes


def test_rules_of_three_store_no_more_than_facts_and_rules(spark, monkeypatch):
    """Two of three codes often go together in all these poses, three never often enough: candidates would be hundreds of thousands."""
    r = random.Random(4)
    table = [(i, catalog.OFFSET[c.kind] + catalog.KINDS[c.kind].categories.index(c.accepted[0])) for i, c in enumerate(catalog.CODES) if c.accepted][:120]
    rows = [(p, *x) for p in range(300) for x in table if r.random() < 0.72] + [(p, *x) for p in range(300, 370) for x in table[:3]]
    facts = spark.createDataFrame(rows, "pose_id long, code_id int, intptt_id int")
    sizes = []

    def counted(df, what):
        out = stages.stored(df, what)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(codes, "stored", counted)
    got = {(x.a, x.b, x.c, x.n, round(x.confidence, 9)) for x in codes.tri_rules(facts).collect()}
    assert max(sizes) <= len(rows)
    has = {}
    for p, c, i in rows:
        has.setdefault(c * 1000 + i, set()).add(p)
    two = {(a, c) for a in has for c in has if a != c and len(has[a] & has[c]) >= max(50, 0.7 * len(has[a]))}
    m = dict(codes.mirror_rows())
    two = {(a, c) for a, c in two if any((m[x], m[y]) == (a, c) for x, y in two)}
    three = {}
    for a in has:
        for b in has:
            ab = has[a] & has[b] if a < b else ()
            for c in has if len(ab) >= 50 else ():
                n = len(ab & has[c])
                if c not in (a, b) and n >= 50 and n >= 0.8 * len(ab) and not {(a, c), (b, c)} & two:
                    three[a, b, c] = n, round(n / len(ab), 9)
    images = {(*sorted((m[a], m[b])), m[c]) for a, b, c in three}
    assert got == {(*k, *v) for k, v in three.items() if k in images}


def test_units_are_ordered_where_their_walk_is_made(spark):
    """A walk is hundreds of times as large as its key, so no table of walks is joined."""
    from kinelex.operators import compose

    rows = spark.createDataFrame([(i, s, p, "above", None, "neck") for i in range(3) for s in ("left", "right") for p in ("hand", "foot")], "pose_id long, side1 string, part1 string, intptt string, side2 string, part2 string")
    units = stages.stored(compose.fuse(rows), "units")
    out = compose.ordered(units)
    assert "Join" not in plan(out) and out.columns == [*units.columns, "spot", "place"]
    got = [r.place for r in out.where("pose_id = 1").collect()]
    assert sorted(got) == list(range(len(got))) and len(got) > 0


@pytest.mark.parametrize("spare", [3.0, None])
def test_pools_are_drawn_in_the_join(spark, spare):
    """Blocks of 16 rows; limits that hide too much are made up for, and with none only few draws leave the join."""
    import hashlib

    from kinelex.operators import metrics

    r = random.Random(2)
    v = [[[r.gauss(0, 1) for _ in range(3)] for _ in range(200)] for _ in range(2)]
    q, t = (spark.createDataFrame([(i, x, 0 if i < 190 else 1) for i, x in enumerate(side)], "id long, v array<double>, label int") for side in v)
    got = {x.id: round(x.mean_rank, 9) for x in metrics.r_precision(q, t, "label", pool=8, repeats=3, rows=16, spare=spare).collect()}
    draw = lambda rep, a, b: hashlib.md5(f"0|pool|{rep}|{a}|{b}".encode()).hexdigest()[:8]
    s = lambda a, b: round(sum(x * y for x, y in zip(v[0][a], v[1][b], strict=True)), 9)
    for i in (0, 17, 189, 195):
        group = range(190) if i < 190 else range(190, 200)
        ranks = [sum(s(i, x) > s(i, i) or (s(i, x) == s(i, i) and x < i) for x in sorted((x for x in group if x != i), key=lambda x: (draw(rep, i, x), x))[:7]) for rep in range(3)]
        assert got[i] == round(sum(ranks) / 3, 9)
    assert len(got) == 200


def test_similar_rows_are_ranked_where_they_are_found(spark):
    """A row hands on its k best in all, not k for every block."""
    from kinelex.operators import blocks

    r = random.Random(3)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(64)], "id long, v array<double>")
    out = blocks.most_similar(df, 5, rows=8)
    assert "Window" not in plan(out) and out.count() == 64 * 5
