"""Exact repeated word passages by level-wise doubling.

A passage of `length` words can only repeat if its halves do.  The first level therefore compares
windows of half the length, and of these only anchors: in each window of full length the half
window of least hash, leftmost of equals.  Equal windows have equal anchors at equal offsets, so
no repeat is lost, and about one half window in `length` / 4 is compared.  Full windows around
anchors that other documents have too are the second level; what repeats there is removed.
From then on windows that repeat at one length alone are extended to twice that length, a
window and its neighbour at a time without reading text again, until no candidate survives.

Texts with the same words are compared once, under their smallest doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stored

#: Windows that a task looks at together.
SLICE = 1 << 19
_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_POSITION = np.uint64((1 << 20) - 1)
#: A null key counts as this one.
LAST = (1 << 63) - 1


class _Powers:
    """Powers of both factors and of their inverses modulo 2 ** 64."""

    n = 0
    up: list[np.ndarray] = []
    down: list[np.ndarray] = []

    @classmethod
    def get(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.n < n:
            cls.n = max(n, SLICE + (1 << 14))
            raised = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(cls.n - 1, x, np.uint64)]), dtype=np.uint64)
            cls.up, cls.down = [raised(x) for x in _ODD], [raised(pow(x, -1, 1 << 64)) for x in _ODD]
        return cls.up[which][:n], cls.down[which][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def windows(words: np.ndarray, n: int, which: int) -> np.ndarray:
    """A hash of the n words from each position; `which` chooses one of two independent families."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _Powers.get(which, len(words) + 1)
    x = words if which == 0 else _mixed(words + np.uint64(_ODD[1]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:-1], dtype=np.uint64)])
    return _mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n entries from each position."""
    m = 1
    while 2 * m <= n:
        x = np.minimum(x[: len(x) - m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (n - m)], x[n - m :]) if m < n else x


def hashed_words(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    words = (text or b"").split()
    return words, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchored(words: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end, text i up to ends[i] -> (position, position of its anchor, hash of its anchor) of each window inside a text."""
    half = (length + 1) // 2
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(words) < length:
        return none
    g = windows(words, half, 0)
    at = np.arange(len(g))
    packed = (g & ~_POSITION) | at.astype(np.uint64)
    anchor = (_least(packed, length - half + 1) & _POSITION).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
    whole = np.flatnonzero(at[: len(anchor)] + length <= ends[text])
    return whole, anchor[whole], g[anchor[whole]]


def slices(words: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in slices of at most SLICE windows: (words, ends, text, first word) of the parts; parts of one text overlap by length - 1 words."""
    parts = []
    for i, w in enumerate(words):
        for first in range(0, max(len(w) - length + 1, 0), SLICE):
            parts.append((i, first, w[first : first + SLICE + length - 1]))
    at = 0
    while at < len(parts):
        size, to = 0, at
        while to < len(parts) and (to == at or size + len(parts[to][2]) <= SLICE):
            size += len(parts[to][2])
            to += 1
        text, first, w = zip(*parts[at:to], strict=True)
        yield np.concatenate(w), np.cumsum([len(x) for x in w]), np.array(text), np.array(first)
        at = to


_BASE = pa.schema([("ord", pa.int64()), ("own", pa.binary()), ("seq", pa.binary()), ("n_words", pa.int64()), ("anchors", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_WINDOW = "id long, ord long, pos int, h1 long, h2 long"
_WINDOW_ARROW = pa.schema([("id", pa.int64()), ("ord", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _ord(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("ord")


def _own(key: str, text: str) -> Column:
    """Tells the texts of one key apart, and a null key from LAST."""
    return F.concat(F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))), F.when(F.col(key).isNull(), F.lit(b"\x01")).otherwise(F.lit(b""))).alias("own")


def _sketched(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """ord, own, seq (a hash of the whole row of words), n_words, anchors and their places; a row per row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, seqs = [], []
            for t in b.column(2).to_pylist():
                words, h = hashed_words(t)
                hashes.append(h)
                seqs.append(xxhash.xxh3_128_digest(b" ".join(words)))
            found: list[list[np.ndarray]] = [[] for _ in hashes]
            for w, ends, which, first in slices(hashes, length):
                _, anchor, h = anchored(w, ends, length)
                new = np.flatnonzero(np.diff(anchor, prepend=-1))
                anchor, h = anchor[new], h[new].view(np.int64)
                part = np.searchsorted(ends, anchor, "right")
                cut = np.searchsorted(part, np.arange(len(ends) + 1))
                for k in range(len(ends)):
                    s = slice(cut[k], cut[k + 1])
                    found[which[k]].append((h[s], anchor[s] - (ends[k - 1] if k else 0) + first[k]))
            joined = [tuple(np.concatenate(x) for x in zip(*f, strict=True)) if f else (np.zeros(0, np.int64),) * 2 for f in found]
            columns = [b.column(0), b.column(1), seqs, [len(h) for h in hashes], [x[0] for x in joined], [x[1].astype(np.int32) for x in joined]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _BASE, strict=True)], schema=_BASE)

    rows = docs.select(_ord(key), _own(key, text), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(sketch, "ord long, own binary, seq binary, n_words long, anchors array<long>, places array<int>")


def _shared(windows: DataFrame, *by: str) -> DataFrame:
    """The hashes that stand in documents of different keys, with the smallest of these.

    Stored, so that a join with it has plain shuffles on both sides: a frequent hash is then split.
    """
    return stored(windows.groupBy(*by).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select(*by, "lo"), "shared")


def _survivors(windows: DataFrame, n: int) -> DataFrame:
    """Windows of n words that stand in documents of different keys; later: a smaller key has it."""
    out = windows.join(_shared(windows, "h1", "h2"), ["h1", "h2"])
    return stored(out.select("id", "ord", "pos", "h1", "h2", (F.col("ord") > F.col("lo")).alias("later")), f"windows-{n}")


def _extended(survivors: DataFrame, n: int) -> DataFrame:
    """Windows of 2 n words whose two halves of n words survive."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, o, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                pos, h1, h2 = (xs.values.field(k).to_numpy() for k in range(3))
                pos, first = np.unique(pos, return_index=True)
                h1, h2 = h1[first].view(np.uint64), h2[first].view(np.uint64)
                after = np.searchsorted(pos, pos + n)
                ok = np.flatnonzero((after < len(pos)) & (pos[np.minimum(after, len(pos) - 1)] == pos + n))
                if len(ok):
                    both = [_mixed(h[ok] * np.uint64(_ODD[k]) + _mixed(h[after[ok]])).view(np.int64) for k, h in enumerate((h1, h2))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), i)), pa.array(np.full(len(ok), o)), pa.array(pos[ok]), *map(pa.array, both)], schema=_WINDOW_ARROW)

    docs = survivors.groupBy("id", "ord").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2"))).alias("xs"))
    return docs.mapInArrow(extend, _WINDOW)


def _words_of(spans: list[list[int]], words: list[bytes]) -> bytes:
    edges = [0, *(e for s in spans for e in s), len(words)]
    return b" ".join(w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z])


_KEPT = "ord long, own binary, n_words long, spans array<struct<start:long,end:long>>, longest long, kept binary"
_KEPT_ARROW = pa.schema([("ord", pa.int64()), ("own", pa.binary()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("longest", pa.int64()), ("kept", pa.binary())])


def deduplicate(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", doubling: bool = True) -> DataFrame:
    """docs -> key (long), n_words, spans array<struct<start, end>>, longest, kept binary; one row per row.

    spans: the maximal ranges of words covered by windows of `length` words that also start in a
    document with a smaller key; kept: the other words, joined by one space; longest: the most words,
    among `length` and its doublings, of a window that a smaller key has too, 0 if none (with
    `doubling` false no further level is asked, and longest is `length` or 0).
    Words are longest runs of anything but ASCII white space; null texts have none.  Windows are
    judged on the input and never cross documents; rows that share a key aren't smaller than each
    other, so they remove nothing from one another; a null key counts as the largest.  Repeated
    rows come out alike; texts of under `length` words keep everything; very long texts are
    searched whole, slice by slice; an empty table gives an empty result; no other column is read.
    """
    ship(docs.sparkSession)
    base = stored(_sketched(docs, key, text, length), "sketches")
    firsts = base.groupBy("seq").agg(F.min("ord").alias("ord"), F.min_by(F.struct("own", "anchors", "places"), F.struct("ord", "own")).alias("x"))
    firsts = stored(firsts.select("seq", "ord", "x.*", F.monotonically_increasing_id().alias("id")), "firsts")

    # level 1: half windows
    anchors = firsts.select("id", "ord", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("id", "ord", F.col("x.anchors").alias("h"), F.col("x.places").alias("pos"))
    open_ = anchors.join(_shared(anchors, "h"), "h").groupBy("id").agg(F.collect_set("pos").alias("open"))
    open_ = stored(firsts.select("id", "ord", "own").join(open_, "id"), "anchors")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full windows around the anchors that are left."""
        for b in batches:
            ids, ords, opened = (b.column(k).to_pylist() for k in range(3))
            hashes = [hashed_words(t)[1] for t in b.column(3).to_pylist()]
            for w, ends, which, first in slices(hashes, length):
                begins = np.concatenate([[0], ends[:-1]])
                pos, anchor, _ = anchored(w, ends, length)
                is_open = np.zeros(len(w), bool)
                for k, i in enumerate(which):
                    there = np.array(opened[i]) - first[k]
                    is_open[there[(there >= 0) & (there < ends[k] - begins[k])] + begins[k]] = True
                pos = pos[is_open[anchor]]
                part = np.searchsorted(ends, pos, "right")
                text = which[part]
                full = [windows(w, length, k)[pos].view(np.int64) for k in range(2)]
                out = [np.array(ids)[text], np.array(ords)[text], (pos - begins[part] + first[part]).astype(np.int32), *full]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=_WINDOW_ARROW)

    # repeated rows bring the text once
    texts = docs.select(_ord(key), _own(key, text), F.col(text).cast("binary").alias("text")).join(open_.select("ord", "own"), ["ord", "own"], "left_semi").dropDuplicates(["ord", "own"])
    n, levels = length, []
    level = _survivors(stored(texts.join(open_, ["ord", "own"]).select("id", "ord", "open", "text").mapInArrow(around, _WINDOW), "candidates"), n)
    removed = level.where("later").groupBy("id").agg(F.collect_set("pos").alias("starts"), F.lit(n).cast("long").alias("longest"))
    while doubling and not level.isEmpty():
        levels.append(level.where("later").select("id", F.lit(n).cast("long").alias("longest")).distinct())
        level, n = _survivors(stored(_extended(level, n), "candidates"), 2 * n), 2 * n
    if len(levels) > 1:
        longest = levels[0]
        for more in levels[1:]:
            longest = longest.unionByName(more)
        removed = removed.drop("longest").join(longest.groupBy("id").agg(F.max("longest").alias("longest")), "id")

    found = stored(firsts.select("seq", F.col("ord").alias("first"), "id").join(removed, "id", "left").drop("id"), "removed")
    verdicts = base.select("ord", "own", "seq").distinct().join(found, "seq")
    # a later document with the words of an earlier one loses all of them
    verdicts = verdicts.select("ord", "own", (F.col("ord") > F.col("first")).alias("copy"), "starts", F.coalesce("longest", F.lit(0)).alias("longest"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out: dict[str, list] = {k: [] for k in _KEPT_ARROW.names}
                for o, own, copy, starts, longest, t in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    words = (t or b"").split()
                    spans: list[list[int]] = []
                    if copy and len(words) >= length:
                        spans = [[0, len(words)]]
                        longest = length << ((len(words) // length).bit_length() - 1) if doubling else length
                    elif starts:
                        s = np.sort(np.array(starts))
                        new = np.flatnonzero(np.diff(s, prepend=-length - 1) > length)
                        spans = np.column_stack([s[new], np.append(s[new[1:] - 1], s[-1]) + length]).tolist()
                    for k, x in zip(out, (o, own, len(words), [{"start": x, "end": z} for x, z in spans], longest, _words_of(spans, words)), strict=True):
                        out[k].append(x)
                yield pa.RecordBatch.from_pydict(out, _KEPT_ARROW)

    texts = docs.select(_ord(key), _own(key, text), F.col(text).cast("binary").alias("text"))
    out = texts.join(verdicts, ["ord", "own"]).select("ord", "own", "copy", "starts", "longest", "text").mapInArrow(keep, _KEPT)
    return out.select(F.when(F.octet_length("own") == 16, F.col("ord")).alias(key), "n_words", "spans", "longest", "kept")


def brute_force(rows: list[tuple[int | None, bytes | None]], length: int) -> list[tuple[int | None, int, int, int, str]]:
    """The same by definition, for tests: key, n_words, n_removed, longest, kept_sha256 of each row."""
    order = lambda k: LAST if k is None else k
    texts = [(order(k), (t or b"").split()) for k, t in rows]

    def repeated(n: int) -> list[list[int]]:
        first: dict[tuple, int] = {}
        for k, w in texts:
            for p in range(len(w) - n + 1):
                x = tuple(w[p : p + n])
                first[x] = min(k, first.get(x, k))
        return [[p for p in range(len(w) - n + 1) if first[tuple(w[p : p + n])] < k] for k, w in texts]

    gone = [{q for p in s for q in range(p, p + length)} for s in repeated(length)]
    longest, n = [0] * len(rows), length
    while any(found := repeated(n)):
        longest = [n if s else x for s, x in zip(found, longest, strict=True)]
        n *= 2
    kept = [b" ".join(x for p, x in enumerate(w) if p not in g) for (_, w), g in zip(texts, gone, strict=True)]
    return [(k, len(w), len(g), x, hashlib.sha256(t).hexdigest()) for (k, _), (_, w), g, x, t in zip(rows, texts, gone, longest, kept, strict=True)]
