"""Near-duplicates by SimHash fingerprints and exact word-shingle similarity.

A text is the set of its five-word shingles.  Operator 7 places texts in classes by their fingerprints, and each text is
held against the first of its class.  MinHash bands propose what lies beyond 4 differing bits, as most pairs near 0.8 do.
Both only propose; each pair counts after the Jaccard similarity of its whole shingle sets is computed.  At a similarity of 0.8 the
bands miss a pair with probability (1 - 0.8 ** ROWS) ** BANDS, about five in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import simhash
from .common import ROW, fields, numbered, only, scratch, stored, surplus, unpacked, without_rows
from .components import components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 40, 6
#: How often texts that can reach nobody are taken out before all that is left is compared.
TURNS = 3
_KEYS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text: A-Z lower-cased, ASCII-space words; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key per band; none for a text without words."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        x = (hashes[at : at + (1 << 12), None] ^ _KEYS[0]) * _KEYS[1]
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * _KEYS[0]).min(axis=0))
    parts = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], np.uint64).view(np.int64).tolist()


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what is made of one stays small."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        texts = b.column(1).to_pylist()
        sets = [shingles(t) for t in texts]
        same = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), same, pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array([simhash.fingerprint(t) for t in texts], pa.int64())], ["row", "same", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["row", "set"])


def _sets_of(named: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """row, set: the whole shingle sets of some rows of docs."""
    texts = only(docs.select(F.col(ROW).alias("row"), F.col(text).cast("binary").alias("text")), named)
    return texts.mapInArrow(_sets, "row long, set array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Those of the pairs (a, b) of rows of docs that are similar enough by their whole shingle sets."""
    pairs = stored(pairs.distinct(), "pairs")
    ends = stored(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct(), "ends")
    sets = stored(_sets_of(ends, docs, text), "sets")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return stored(both.where(shared >= LEAST * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "similar")


def members(docs: DataFrame, text: str = "text") -> DataFrame:
    """Numbered texts (row, text) -> row, component: rows linked by pairs of similarity LEAST or more share one.

    Equal shingle sets collapse first.  Then every text is held against the first of its class of
    operator 7, and against a leader of each of its bands, which settles most groups in linear time.  Only in bands that still hold several
    components more is asked: shingles that no other text of such bands has can't be shared, so
    they bound a pair's similarity; texts that can reach nobody go, the others are held against
    the text of fewest such shingles, and last against all that the bound still allows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(ROW).alias("row"), F.col(text).cast("binary").alias("text"))
    sketches = stored(rows.mapInArrow(_sketches, "row long, same binary, n long, bands array<long>, fp long"), "sketches")
    nodes = stored(sketches.groupBy("same").agg(F.min("row").alias("node"), F.min_by("n", "row").alias("n"), F.min_by("bands", "row").alias("bands"), F.min_by("fp", "row").alias("fp")), "nodes")
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    open_keys = stored(keys.join(several, "key").select("node", "n", F.col("n").alias("reach"), "key", F.col("node").alias("component")), "bands")
    # reach: how many of its n shingles a text can share at most
    shared, both = F.least("reach", "other_reach"), F.col("n") + F.col("m")
    fits = (F.col("component") != F.col("d")) & (shared >= LEAST * (both - shared))
    links = comp = None

    def verified(pairs: DataFrame) -> None:
        """Adds the links among the pairs, and leaves open only bands that hold more than one component."""
        nonlocal links, comp, open_keys
        more = _verified(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")), docs, text)
        links = more if links is None else links.union(more)
        comp = components(links)
        known = open_keys.drop("component").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_keys = _mixed(known)

    def led(by: Column) -> DataFrame:
        x = F.min(F.struct(by.alias("by"), F.xxhash64("node", "key").alias("h"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("reach").alias("other_reach"), F.col("component").alias("d")))
        leaders = open_keys.groupBy("key").agg(x.alias("x")).select("key", "x.other", "x.m", "x.other_reach", "x.d")
        return open_keys.join(leaders, "key").where(fits)

    alike = simhash.placed(nodes.select(F.col("node").alias("id"), "fp"))
    verified(alike.where("id <> component_id").select(F.col("id").alias("node"), F.col("component_id").alias("other")))
    verified(led(F.lit(0)))
    open_nodes = stored(open_keys.select(F.col("node").alias("row")).distinct(), "open")
    sets = stored(_sets_of(open_nodes, docs, text).select(F.col("row").alias("node"), F.explode("set").alias("shingle")), "shingles")
    for _ in range(TURNS):
        # what only one component holds can't link it to another; texts that go may leave more of that behind
        held = sets.join(open_keys.select("node", "component").distinct(), "node")
        common = held.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
        reach = stored(held.join(common, "shingle").groupBy("node").agg(F.count("*").alias("reach")), "reach")
        known = open_keys.drop("reach").join(reach, "node").where(F.col("reach") >= LEAST * F.col("n"))
        open_keys = _mixed(known.select("node", "n", "reach", "key", "component"))
    verified(led(1 - F.col("reach") / F.col("n")))
    # a pair that shares several bands meets in the first of them alone
    of_node = open_keys.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("bands"))
    mine = open_keys.join(of_node, "node")
    rest = mine.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("reach").alias("other_reach"), F.col("component").alias("d"), F.col("bands").alias("other_bands"))
    first = F.element_at(F.array_intersect("bands", "other_bands"), 1) == F.col("key")
    verified(mine.join(rest, "key").where(fits & (F.col("node") < F.col("other")) & first))
    placed = nodes.select("same", "node").join(comp, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    return sketches.select("row", "same").join(placed, "same").select("row", "component")


def _mixed(keys: DataFrame) -> DataFrame:
    """Those of the bands that hold more than one component."""
    mixed = keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return stored(keys.join(mixed, "key"), "unsettled")


def keep_first(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component, that of the smallest doc_id; null ids come last.

    Null, empty and blank texts have no shingles and so are one class; texts of under five words
    are one shingle; very long texts are compared whole; of repeated rows one stays; an empty table
    gives an empty result; all columns of `docs` come back.
    """
    rows = numbered(docs)
    with scratch(docs.sparkSession) as kept:
        gone = kept(surplus(rows, members(fields(rows, "text"))), "surplus")
    return unpacked(without_rows(rows, gone))
