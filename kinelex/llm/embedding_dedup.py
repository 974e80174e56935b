"""Embedding near-duplicates with a forest of random-projection trees.

Each tree splits recursively: a random direction per node, a threshold at the median of the
node's sample, and both children for rows near it (spill).  The forest is fitted on a bounded
sample on the driver; every row is then routed by the tasks, vectors are compared only within
their leaves, and what the trees find is verified in double precision and united.

Links never leave a task one by one: a leaf hands on, for each of its rows, how many vectors it
is linked to and which row stands for its component.  A link that several leaves see is counted
in the first of them alone, which both rows know by the leaves they carry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stored
from .components import components


class Forest:
    """Thresholds of all trees, by (dim, tree, node); node 1 is a root, 2i and 2i+1 its children.

    Directions are drawn from (seed, dim, tree, node) and not stored.  Nodes that got under
    `least` sample rows have no threshold of their own: they split at their sample's mean, or
    at 0 without any, so trees may be deeper than the sample reaches.
    """

    def __init__(self, trees: int, spill: float, seed: int, least: int = 32):
        self.trees, self.spill, self.seed, self.least = trees, spill, seed, least
        self.at: dict[tuple[int, int, int], float] = {}

    def direction(self, dim: int, tree: int, node: int) -> np.ndarray:
        v = np.random.default_rng([self.seed, dim, tree, node]).standard_normal(dim)
        return v / np.linalg.norm(v)

    def fit(self, sample: list[np.ndarray], depth: int) -> Forest:
        for dim in {len(v) for v in sample}:
            x = np.stack([v for v in sample if len(v) == dim])
            for tree in range(self.trees):
                open_nodes = [(1, np.arange(len(x)))]
                for _ in range(depth):
                    below = []
                    for node, rows in open_nodes:
                        if len(rows) == 0:
                            continue
                        p = x[rows] @ self.direction(dim, tree, node)
                        t = float(np.median(p)) if len(rows) >= self.least else float(p.mean())
                        self.at[dim, tree, node] = t
                        if len(rows) >= self.least:
                            below += [(2 * node, rows[p <= t]), (2 * node + 1, rows[p > t])]
                    open_nodes = below
        return self

    def route(self, x: np.ndarray, depth: np.ndarray, tree: int) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) of one tree; `depth` is the depth at which each row's tree ends."""
        dim, out, stack = x.shape[1], [], [(1, 0, np.arange(len(x)))]
        while stack:
            node, level, rows = stack.pop()
            ends = depth[rows] <= level
            if ends.any():
                out.append((node, rows[ends]))
                rows = rows[~ends]
            if len(rows):
                p = x[rows] @ self.direction(dim, tree, node) - self.at.get((dim, tree, node), 0.0)
                stack += [(2 * node, level + 1, rows[p <= self.spill]), (2 * node + 1, level + 1, rows[p > -self.spill])]
                stack = [s for s in stack if len(s[2])]
        return out


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


#: Leaves are numbered (tree, node); a tree has fewer nodes than this.
TREE = 1 << 40


def _shared(one: list[np.ndarray], two: list[np.ndarray], before: int) -> np.ndarray:
    """Whether row i of one and row j of two share a leaf below `before`; each row's leaves are given as numbers."""
    x, y = (np.concatenate([m[m < before] for m in ms]) for ms in (one, two))
    common = np.intersect1d(x, y)
    out = np.zeros((len(one), len(two)), bool)
    for at in range(0, len(common), 512):
        part = common[at : at + 512]
        has = [np.stack([np.isin(part, m, assume_unique=True) for m in ms]).astype(np.float32) for ms in (one, two)]
        out |= has[0] @ has[1].T > 0
    return out


def _near(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least `cosine`; what lies within rounding of it is computed again, row by row."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    s = (x @ y.T) / np.outer(nx, ny)
    near = s >= cosine
    r, c = np.nonzero(np.abs(s - cosine) < 1e-9)
    for at in range(0, len(r), 1 << 16):
        i, j = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
        near[i, j] = (x[i] * y[j]).sum(axis=1) / (nx[i] * ny[j]) >= cosine
    return near


def _leads(near: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For both sides of a table of links the smallest id that each row reaches inside it."""
    none = np.iinfo(np.int64).max
    left, right = one.copy(), two.copy()
    while True:
        to = np.minimum(right, np.where(near, left[:, None], none).min(axis=0, initial=none))
        back = np.minimum(left, np.where(near, to[None, :], none).min(axis=1, initial=none))
        if (to == right).all() and (back == left).all():
            return left, right
        left, right = back, to


def linked(vectors: DataFrame, cosine: float, trees: int = 8, leaf_rows: int = 400, block_rows: int = 1500, sample_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """vectors (id, label, copies, v array of numbers; distinct, finite, not zero) -> id, n, lead: per leaf and linked
    row, the copies of the rows it is linked to that no earlier leaf counts, and the smallest id it reaches there.

    sample_rows bounds what the forest is fitted on (the rows of smallest id hash); all rows
    are indexed.  A leaf of over `block_rows` rows is compared in blocks, every block against
    every other, so no leaf is cut short and no task holds more than two blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    counts = vectors.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    depth_of = lambda n: F.greatest(F.lit(0), F.ceil(F.log2(n / leaf_rows))).cast("int")
    most = counts.agg(F.max("n")).first()[0] or 0
    sample = [np.asarray(r.v, float) / np.linalg.norm(r.v) for r in vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select("v").toLocalIterator()] if most > leaf_rows else []
    dims = [len(v) for v in sample]
    dim = max(dims, default=1)
    # two unit vectors at the threshold differ by this along a random direction, at one sigma
    apart = math.sqrt(2 * (1 - cosine) / dim)
    forest = Forest(trees, apart / 2, seed).fit(sample, math.ceil(math.log2(max(2, len(sample) / 32))))
    model = spark.sparkContext.broadcast(forest)

    number = pa.float32() if "float" in dict(vectors.dtypes)["v"] else pa.float64()

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        for b in batches:
            d = b.to_pandas()
            for width, part in d.groupby(d["v"].map(len)):
                x, ends = _stack(part["v"]), part["depth"].to_numpy()
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                # a tree without splits says the same each time, so rows of such labels go through one tree
                found = [(tree * TREE + leaf, rows[(ends[rows] > 0) | (tree == 0)]) for tree in range(1 if ends.max() == 0 else forest.trees) for leaf, rows in forest.route(x, ends, tree)]
                who, where = np.concatenate([r for _, r in found]), np.repeat([m for m, _ in found], [len(r) for _, r in found])
                by = np.lexsort((where, who))
                marks = np.split(where[by], np.cumsum(np.bincount(who, minlength=len(x)))[:-1])
                for mark, rows in found:
                    if len(rows):
                        got = part.iloc[rows]
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(pa.array(got[c], pa.int64()) for c in ("label",)), pa.array([width] * len(rows), pa.int32()), pa.array([mark] * len(rows), pa.int64()),
                                pa.array(got["id"], pa.int64()), pa.array(got["copies"], pa.int64()), pa.array(got["v"].tolist(), pa.list_(number)), pa.array([marks[r] for r in rows], pa.list_(pa.int64())),
                            ],
                            ["label", "dim", "leaf", "id", "copies", "v", "marks"],
                        )

    deep = vectors.join(counts.select(F.col("label").alias("__l"), F.col("dim").alias("__d"), depth_of(F.col("n")).alias("depth")), (F.col("label") == F.col("__l")) & (F.size("v") == F.col("__d")))
    routed = stored(deep.select(F.col("label").cast("long"), "id", "copies", "v", "depth").mapInArrow(leaves, f"label long, dim int, leaf long, id long, copies long, v {dict(vectors.dtypes)['v']}, marks array<long>"), "leaves")
    key = ["label", "dim", "leaf"]
    blocks = routed.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = routed.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        """One block against itself or another: both sides' counts and leads."""
        leaf, alone = int(g["leaf"].iloc[0]), g["i"].iloc[0] == g["j"].iloc[0]
        sides = [g[g["block"] == g["i"]], g[g["block"] == g["j"]]]
        x, y = (_stack(s["v"]) for s in sides)
        one, two = (s["id"].to_numpy() for s in sides)
        near = _near(x, y, cosine)
        if alone:
            np.fill_diagonal(near, False)
        left, right = _leads(near, one, two)
        own = near & ~_shared(sides[0]["marks"].tolist(), sides[1]["marks"].tolist(), leaf)
        n_left, n_right = own @ sides[1]["copies"].to_numpy(), sides[0]["copies"].to_numpy() @ own
        out = [pd.DataFrame({"id": one, "n": n_left, "lead": left})[near.any(axis=1)]]
        if not alone:
            out.append(pd.DataFrame({"id": two, "n": n_right, "lead": right})[near.any(axis=0)])
        return pd.concat(out)

    return placed.groupBy(*key, "i", "j").applyInPandas(compare, "id long, n long, lead long")


def classes(rows: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """rows -> id, n_links, component_id, kept; one row per row.

    Rows are compared only with rows of the same label.  A null id, label or vector, a zero
    vector, and null or non-finite components link with nothing (component_id is then the id,
    n_links 0, kept true; a null id has a null component and is kept).  Vectors of different
    length don't link.  Equal vectors collapse before the search and count as linked copies, so
    repeated rows cost nothing.  Empty table: empty result.  Other columns are not read.
    """
    # vectors of floats travel as floats; every comparison is made in double precision
    v = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    d = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & (norm > 0)
    d = d.withColumn("ok", F.coalesce(usable, F.lit(False)))
    same = stored(d.where("ok").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "vectors")
    found = stored(linked(same.select(F.col("first").alias("id"), "label", "copies", "v"), cosine, **options), "links")
    others = found.groupBy(F.col("id").alias("a")).agg(F.sum("n").alias("linked"))
    comp = components(found, "id", "lead")
    told = same.join(others, F.col("first") == F.col("a"), "left").join(comp, F.col("first") == F.col("node"), "left")
    told = told.select(F.col("label").alias("__l"), F.col("v").alias("__v"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "first").alias("c"))
    out = d.join(told, F.col("ok") & (F.col("label") == F.col("__l")) & (F.col("v") == F.col("__v")), "left")
    component = F.coalesce("c", "id")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
