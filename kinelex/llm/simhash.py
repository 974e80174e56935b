"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints that differ in at most 4 bits, cut into 3 segments instead of 5, have a segment
that differs in at most one bit.  Each segment is indexed once per bit with that bit as a
wildcard, so such segments share a variant: an equality join on the variants finds every
pair, and the join condition verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import ROW, fields, numbered, scratch, stored, surplus, unpacked, without_rows
from .components import components

#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE, SEED = 4, 42


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of a whole UTF-8 text: A-Z lower-cased, ASCII-space words, 4-word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> id, fp (long).  Null, empty and blank texts have fingerprint 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, fp long")


def _segment(x: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> each pair (a, b), a < b, at `most` differing bits, once.

    most: up to 5, so that three segments leave one with at most one differing bit.
    """
    assert most < 2 * len(SEGMENTS), "with more differing bits no segment need be within one"
    keys = [
        F.struct(F.lit(first + i).alias("bit"), _segment(F.col("fp"), first, width).bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i))).alias("rest"))
        for first, width in SEGMENTS
        for i in range(width)
    ]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.bit", "k.rest")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first_variant = F.lit(None).cast("int")
    for first, width in reversed(SEGMENTS):
        d = _segment(x, first, width)
        first_variant = F.when(F.bit_count(d) <= 1, F.when(d == 0, F.lit(first)).otherwise(F.lit(first) + F.bit_count(d - 1))).otherwise(first_variant)
    # of the variants that a pair shares only the first counts, so no pair comes twice
    on = (F.col("a.bit") == F.col("b.bit")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= most) & (F.col("a.bit") == first_variant)
    return index.alias("a").join(index.alias("b"), on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """docs -> one row per row of docs: id, fp, component_id (smallest id reachable, own included).

    Equal fingerprints collapse before anything is compared, so copies cost nothing however
    many there are.  A null id is never the smallest unless its component has no other; repeated
    rows stay; an empty table gives an empty result.  Only `key` and `text` are read.
    """
    return placed(stored(fingerprints(docs, key, text), "simhash"), most)


def placed(fps: DataFrame, most: int = 4) -> DataFrame:
    """Stored fingerprints (id, fp) -> id, fp, component_id, as `classes` returns them."""
    firsts = stored(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-firsts")
    comp = components(links(firsts.select("fp"), most)).withColumnRenamed("node", "fp")
    named = firsts.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, most: int = 4) -> DataFrame:
    """Exactly one row of each component, that of the smallest doc_id; null ids come last."""
    rows = numbered(docs)
    with scratch(docs.sparkSession) as kept:
        members = classes(fields(rows, "text"), key=ROW, most=most).select(F.col("id").alias(ROW), F.col("component_id").alias("component"))
        gone = kept(surplus(rows, members), "surplus")
    return unpacked(without_rows(rows, gone))
