"""All rows of one table against all rows of another, as products of bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import by_length, draws
from ..functions.shipping import ship

#: Rows of a block, on average; a task holds two blocks and their product.
ROWS = 2048
#: Most rows of which a task keeps the best of all others, and how many of them it multiplies at once.
QUERIES, STRIP = 16_384, 512
#: Rows of a block that draw for their pools, on average; how many draws are scored at once, and how many wait to be put in order.
DRAWING, SCORED, HELD = 1024, 131_072, 1 << 20


def n_blocks(df: DataFrame, rows: int = ROWS) -> int:
    """Follows from the size of the table: each block has `rows` rows on average, however large that is."""
    return max(1, -(-df.count() // rows))


def matrix(t: pa.Table, name: str) -> np.ndarray:
    """A column of equally long arrays of numbers as a matrix."""
    flat = t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))


def every_block_pair(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int = ROWS) -> DataFrame:
    """`work` on each pair of a block of left and a block of right (both with a column `id`); what it returns, in one table.

    Rows are dealt by a hash of their id.  Every row goes to as many tasks as the other side has
    blocks, so what is shuffled grows with the product of the sizes over `rows`, and no task
    with more than its two blocks.
    """
    ship(left.sparkSession)
    nl, nr = n_blocks(left, rows), n_blocks(right, rows)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = left.select(block(nl).alias("l"), every(nr).alias("r"), *left.columns)
    b = right.select(every(nl).alias("l"), block(nr).alias("r"), *right.columns)
    # the two sides may be one table: the second gets names of its own
    b = b.toDF("l2", "r2", *(f"{c}_2" for c in right.columns))
    names = left.columns, right.columns

    def joined(x: pa.Table, y: pa.Table) -> pa.Table:
        return work(*(t.select(t.column_names[2:]).rename_columns(n) for t, n in zip((x, y), names, strict=True)))

    return a.groupBy("l", "r").cogroup(b.groupBy("l2", "r2")).applyInArrow(joined, schema)


def most_similar(features: DataFrame, k: int = 100, apart: str | None = None, rows: int | None = None) -> DataFrame:
    """features (id, v) with v of unit length -> b, a, similarity, rank: the k most similar a of every b, of all rows.

    apart: a column whose value must differ, or else be null on either side; that holds before the k
    are taken.  All rows pass by each block of `rows` b (a sixteenth of them, but 2048 to 16384) in batches, and the block keeps the k best of each
    b so far, so a b hands on k rows in all; ties go to the smaller a.  Similarities are rounded to six
    decimals before they are ordered.
    """
    ship(features.sparkSession)
    n = n_blocks(features, rows or min(QUERIES, max(ROWS, features.count() // 16)))
    f = features.select("id", "v", (F.col(apart) if apart else F.lit(None).cast("int")).alias("apart"))
    mine = f.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.lit(0).alias("side"), "*")
    theirs = f.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"), F.lit(1).alias("side"), "*")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        known: dict = {None: -1}
        codes = lambda b, none: np.array([none if x is None else known.setdefault(x, len(known)) for x in b.column("apart").to_pylist()], np.int64)
        block = None
        for batch in batches:
            n_mine = int((batch.column("side").to_numpy() == 0).sum())
            if n_mine:
                if block is not None:
                    raise RuntimeError("a block's own rows must come first")
                held.append(batch.slice(0, n_mine))
            a = batch.slice(n_mine)
            if a.num_rows and (a.column("side").to_numpy() == 0).any():
                raise RuntimeError("a block's own rows must come first")
            if not a.num_rows or not held:
                continue
            if block is None:
                own = pa.Table.from_batches(held)
                ids, v, of = own.column("id").to_numpy(), matrix(own, "v"), np.concatenate([codes(x, -1) for x in held])
                block, top_a, top_s = len(ids), np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)
            ids_a, of_a, va = a.column("id").to_numpy(), codes(a, -2), matrix(pa.Table.from_batches([a]), "v")
            for at in range(0, block, STRIP):
                part = slice(at, at + STRIP)
                s = v[part] @ va.T
                # what is under the k-th best so far can't be among the k best; a tie may
                least = top_s[part, -1:]
                if np.isinf(least).any() and a.num_rows > k:  # not full yet: the batch's own k-th best is a bound too
                    s[(ids[part][:, None] == ids_a) | (of[part][:, None] == of_a)] = -np.inf
                    least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k, None])
                row, col = np.nonzero(s >= least - 1e-6)
                there = (ids[part][row] != ids_a[col]) & (of[part][row] != of_a[col])
                row, col = row[there], col[there]
                value = np.round(s[row, col], 6) + 0.0
                touched = np.unique(row)
                rows_ = np.concatenate([row, np.repeat(touched, k)])
                values = np.concatenate([value, top_s[part][touched].ravel()])
                found = np.concatenate([ids_a[col], top_a[part][touched].ravel()])
                order = np.lexsort((found, -values, rows_))
                rows_, values, found = rows_[order], values[order], found[order]
                place = np.arange(len(rows_)) - np.searchsorted(rows_, rows_)
                kept = place < k
                top_s[at + rows_[kept], place[kept]], top_a[at + rows_[kept], place[kept]] = values[kept], found[kept]
        if block:
            for at in range(0, block, STRIP):
                row, place = np.nonzero(np.isfinite(top_s[at : at + STRIP]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at + row], top_a[at + row, place], top_s[at + row, place], (place + 1).astype(np.int32))], ["b", "a", "similarity", "rank"])

    both = mine.unionByName(theirs).repartition(n, "block").sortWithinPartitions("block", "side")
    return both.groupBy("block").applyInArrow(best, "b long, a long, similarity double, rank int")


def counts_ahead(queries: DataFrame, targets: DataFrame, own: Column, rows: int = ROWS) -> DataFrame:
    """queries (id, v, own), targets (id, v) -> id, rank: how many targets score higher than `own`, or equal with a smaller id."""
    q = queries.select("id", "v", own.alias("own"))

    def ahead(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = a.column("id").to_numpy()
        n = np.zeros(len(ids), np.int64)
        if len(ids) and b.num_rows:
            mine, theirs = a.column("own").to_numpy()[:, None], b.column("id").to_numpy()[None, :]
            s = np.round(matrix(a, "v") @ matrix(b, "v").T, 9)
            n = ((s > mine) | ((s == mine) & (theirs < ids[:, None]))).sum(axis=1)
        return pa.table({"id": ids, "rank": n})

    found = every_block_pair(q, targets.select("id", "v"), ahead, "id long, rank long", rows)
    return found.groupBy("id").agg(F.sum("rank").alias("rank"))


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays of numbers as a matrix, by component, and each row's length; -1 if the array is null or holds a null."""
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    there = np.arange(max(n.max(initial=0), 0))[None, :] < n[:, None]
    values = column.flatten()
    out = np.zeros(there.shape)
    out[there] = pc.fill_null(pc.cast(values, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    if values.null_count:
        n[np.unique(np.nonzero(there)[0][values.is_null().to_numpy(zero_copy_only=False)])] = -1
    return np.ascontiguousarray(out.T), n


def nine_places(x: np.ndarray) -> np.ndarray:
    """Rounded as SQL does it: halves away from zero."""
    with np.errstate(all="ignore"):
        y = x * 1e9
        whole = np.trunc(y)
        return np.where(np.isfinite(y), (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 1e9, x) + 0.0


def is_ahead(s: np.ndarray, own: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """s > own, or equal and `smaller`; a NaN exceeds every number and equals a NaN."""
    odd, own_odd = np.isnan(s), np.isnan(own)
    return np.where(odd | own_odd, (odd & ~own_odd) | (odd & own_odd & smaller), (s > own) | ((s == own) & smaller))


def pools(asked: DataFrame, targets: DataFrame, bucket: str, most: int, seed: int, parts: int) -> DataFrame:
    """asked (bucket, block, id, v, own, reps, below), targets (bucket, block, id, v) -> q, rep, own, n, rank.

    For each rep of a row, every target of its block but its own draws; the `most` lowest draws (ties: smaller id) make
    the pool, of which n counts the rows and rank those ahead of `own`.  Draws of `below` and over are left out; null: none.
    The targets pass by in batches: a task holds its own rows and the draws that may be among the lowest.
    """
    ship(asked.sparkSession)
    mine = asked.select(bucket, "block", F.lit(0).alias("side"), "id", "v", "own", "reps", "below")
    theirs = targets.select(bucket, "block", F.lit(1).alias("side"), "id", "v")

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None
        for batch in batches:
            n_mine = int((batch.column("side").to_numpy() == 0).sum())
            if n_mine:
                if block is not None:
                    raise RuntimeError("a block's own rows must come first")
                held.append(batch.slice(0, n_mine))
            t = batch.slice(n_mine)
            if t.num_rows and (t.column("side").to_numpy() == 0).any():
                raise RuntimeError("a block's own rows must come first")
            if not t.num_rows or not held:
                continue
            block = block or Pools(pa.Table.from_batches(held), most, seed)
            block.draw(t.column("id").to_numpy(), padded(t.column("v")))
        if block is not None:
            yield from block.ranked()

    both = mine.unionByName(theirs, allowMissingColumns=True).repartition(parts, bucket, "block").sortWithinPartitions(bucket, "block", "side")
    return both.groupBy(bucket, "block").applyInArrow(pooled, "q long, rep int, own double, n long, rank long")


class Pools:
    """The pools of one block's rows while targets pass by."""

    def __init__(self, rows: pa.Table, most: int, seed: int) -> None:
        self.most = most
        self.ids = rows.column("id").to_numpy()
        self.v, self.length = padded(rows.column("v").combine_chunks())
        self.no_own = rows.column("own").is_null().to_numpy()
        self.own = nine_places(rows.column("own").fill_null(0.0).to_numpy())
        # of each row and rep, that is of each line below:
        reps = rows.column("reps").combine_chunks()
        self.row, rep = pc.list_parent_indices(reps).to_numpy().astype(np.int64), reps.flatten().to_numpy()
        below = rows.column("below").fill_null(1 << 32).to_numpy()[self.row]
        self.last, self.all = (below - 1).astype(np.uint32), below >= 1 << 32
        q = self.ids[self.row]
        self.heads = list(by_length([f"{seed}|pool|{r}|{i}|".encode() for r, i in zip(rep.tolist(), q.tolist(), strict=True)]))
        # rows of one id share their pools
        _, first, pool = np.unique(np.stack([q, rep]), axis=1, return_index=True, return_inverse=True)
        self.pool, self.pool_q, self.pool_rep = pool.ravel(), q[first], rep[first]
        self.low: list[tuple[np.ndarray, ...]] = []  # of each draw kept: pool, draw, target, ahead, row
        self.held = 0

    def draw(self, ids: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> None:
        found, n = [], 0
        for of_tails, tails in by_length([str(i).encode() for i in ids.tolist()]):
            for of_heads, heads in self.heads:
                for p, t, x in draws(heads, tails):
                    line, to = of_heads[p : p + x.shape[0]], of_tails[t : t + x.shape[1]]
                    last = self.last[line, None]
                    if x.shape[1] > 2 * self.most and self.all[line].any():
                        x = np.where(ids[to] == self.ids[self.row[line], None], np.uint32((1 << 32) - 1), x)
                        last = np.minimum(last, np.partition(x, self.most - 1, axis=1)[:, self.most - 1, None])
                    hit = np.flatnonzero(x <= last)
                    found.append((line[hit // x.shape[1]], to[hit % x.shape[1]], x.ravel()[hit]))
                    n += len(hit)
                    if n >= SCORED:
                        self.score(found, ids, vectors)
                        found, n = [], 0
        if n:
            self.score(found, ids, vectors)

    def score(self, found: list[tuple[np.ndarray, ...]], ids: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> None:
        line, to, x = (np.concatenate(a) for a in zip(*found, strict=True))
        other = ids[to] != self.ids[self.row[line]]
        line, to, x = line[other], to[other], x[other]
        row, (v, length) = self.row[line], vectors
        s = np.zeros(len(row))
        with np.errstate(all="ignore"):
            for mine, theirs in zip(self.v, v, strict=False):  # from left to right, as `dot` does
                s += mine[row] * theirs[to]
        known = (self.length[row] == length[to]) & (length[to] >= 0) & ~self.no_own[row]
        ahead = known & is_ahead(nine_places(s), self.own[row], ids[to] < self.ids[row])
        self.low.append((self.pool[line], x, ids[to], ahead, row))
        self.held += len(row)
        if self.held > HELD + self.most * len(self.pool_q):
            self.settle()

    def settle(self) -> None:
        """Keeps the lowest draws of each pool, in order."""
        pool, x, ids, ahead, row = (np.concatenate(a) for a in zip(*self.low, strict=True))
        order = np.lexsort((ids, x, pool))
        order = order[np.arange(len(order)) - np.searchsorted(pool[order], pool[order]) < self.most]
        self.low, self.held = [(pool[order], x[order], ids[order], ahead[order], row[order])], len(order)

    def ranked(self) -> Iterator[pa.RecordBatch]:
        if not self.low:
            return
        self.settle()
        pool, _, _, ahead, row = self.low[0]
        if not len(pool):
            return
        which, first, n = np.unique(pool, return_index=True, return_counts=True)
        own = np.maximum.reduceat(np.where(self.no_own, -np.inf, self.own)[row], first)
        none = np.logical_and.reduceat(self.no_own[row], first)
        columns = [self.pool_q[which], self.pool_rep[which], pa.array(own, mask=none), n, np.add.reduceat(ahead.astype(np.int64), first)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "rep", "own", "n", "rank"])
