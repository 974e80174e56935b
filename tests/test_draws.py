"""Pools are drawn in blocks, with the numbers and the ranks of SQL."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import spark_rows, sql_rows
from kinelex.functions import draws, stages
from kinelex.operators import blocks
from kinelex.plans import all as plans


@pytest.mark.parametrize("at_once", [40, draws.AT_ONCE])
def test_draws_are_the_first_digits_of_md5(monkeypatch, at_once):
    monkeypatch.setattr(draws, "AT_ONCE", at_once)
    ids = [0, 7, 10, 99, 123, 9999, 12345, 678901, 2**31, -1, -45, 2**63 - 1, -(2**63)]
    heads = [f"{seed}|pool|{rep}|{q}|".encode() for seed in (0, 2**40) for rep in (0, 12) for q in ids]
    tails = [str(t).encode() for t in [*ids, *range(500, 530)]]
    got = {}
    for of_heads, h in draws.by_length(heads):
        for of_tails, t in draws.by_length(tails):
            for p, c, x in draws.draws(h, t):
                got |= {(of_heads[p + i], of_tails[c + j]): int(x[i, j]) for i in range(x.shape[0]) for j in range(x.shape[1])}
    assert got == {(i, j): int(hashlib.md5(h + t).hexdigest()[:8], 16) for i, h in enumerate(heads) for j, t in enumerate(tails)}


def test_no_row_is_made_for_a_draw(spark, tmp_path, monkeypatch):
    """A draw that takes a row, a text and a digest of its own takes about a microsecond, and there are ten for each two rows of a label."""
    table(tmp_path, 400, 2)
    made, plain = [], stages.written
    monkeypatch.setattr(stages, "written", lambda df, path: made.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, path))
    out = plans.queries()["q_r_precision"](spark, str(tmp_path))
    assert out.count() == 200 and not any("md5" in x for x in made)


@pytest.mark.parametrize("query", ["q_r_precision", "q_top_precision"])
def test_pools_of_odd_rows_agree_with_sql(spark, tmp_path, query):
    """Copies, zeros, NaN, infinities, nulls for vectors and labels; labels with few rows, and one with a single row."""
    r = random.Random(5)
    table(tmp_path, 500, 3, lambda i, v, label: (i, [None, [0.0] * 4, [math.nan] * 4, [math.inf, 1.0, 1.0, 1.0], [0.5, 0.25, 0.125, 1 / 1024], v][r.choice((0, 1, 2, 3, 4, 4, 5, 5, 5, 5))], [None, 77, 78][r.randrange(3)] if r.random() < 0.1 else label), [(1000, [1.0] * 4, 99), (1001, [1.0] * 4, 99)])
    got = spark_rows(plans.queries()[query](spark, str(tmp_path)))
    want = sql_rows(plans.oracle_sql()[query], str(tmp_path))
    assert got[0] == want[0] and got[1] == want[1] and len(got[1]) >= 4


@pytest.mark.parametrize("below", [None, 2**28])
def test_what_a_block_holds_is_bounded(monkeypatch, below):
    """One row's pool while 3000 targets pass by in batches: never more than is waiting and the pools themselves."""
    monkeypatch.setattr(blocks, "HELD", 64)
    monkeypatch.setattr(blocks, "SCORED", 16)
    one = pa.table({"id": [5], "v": [[1.0, 2.0]], "own": [3.0], "reps": pa.array([[0, 1]], pa.list_(pa.int32())), "below": pa.array([below], pa.int64())})
    b, most = blocks.Pools(one, 7, 0), 0
    v = {i: [math.sin(i), math.cos(i)] for i in range(3000)}
    for at in range(0, 3000, 100):
        ids = np.arange(at, at + 100)
        b.draw(ids, blocks.padded(pa.array([v[i] for i in ids])))
        most = max(most, b.held)
    got = [x.to_pylist() for x in b.ranked()][0]
    assert most <= 64 + 7 * 2 + 100 * 2
    for x in got:
        pool = sorted((hashlib.md5(f"0|pool|{x['rep']}|5|{t}".encode()).hexdigest()[:8], t) for t in v if t != 5)[:7]
        s = {t: round(v[t][0] + 2 * v[t][1], 9) for _, t in pool}
        assert (x["q"], x["n"], x["rank"]) == (5, 7, sum(s[t] > 3 or (s[t] == 3 and t < 5) for t in s))
    assert [x["rep"] for x in got] == [0, 1]


def test_arrays_of_a_column_may_be_null_or_ragged():
    v, n = blocks.padded(pa.array([[1.0, 2.0], None, [], [3.0], [None, 4.0]], pa.list_(pa.float32())))
    assert n.tolist() == [2, -1, 0, 1, -1] and v.T.tolist() == [[1, 2], [0, 0], [0, 0], [3, 0], [0, 4]]


def table(folder, n, labels, odd=lambda *x: x, more=()):
    r = random.Random(n)
    rows = [odd(i, [r.gauss(0, 1) for _ in range(4)], r.randrange(labels)) for i in range(n)] + list(more)
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.float32()), pa.int32()), strict=True)]
    pq.write_table(pa.Table.from_arrays(columns, ["vec_id", "embedding", "label"]), folder / "embeddings.parquet")
