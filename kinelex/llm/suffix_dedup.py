"""Exact repeated substrings by suffix arrays over content-defined shards.

A 100-byte window is anchored at its least-hashed K-gram, so equal windows have equal
anchors wherever they stand.  Windows that share an anchor and are neighbours travel as one
piece.  Pieces equal as a whole are settled by a sort; where an anchor has several different
pieces, one of each goes to the anchor's shard.  The pieces of a frequent anchor are cut by where
their windows hold it: windows of one such class have more bytes in common, and these deal them to
shards.  Suffix arrays of bounded size are induced (suffixes are classified, leftmost-smaller
substrings named and sorted first), permuted common prefixes cut them into classes of equal
windows, and all but each class's first window are repeats.  Only anchors, not texts, are
shuffled to find out which pieces repeat.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stored

#: Bytes of an anchoring K-gram.
GRAM = 32
#: Bytes of text that a task anchors at a time; positions in it fit _LOW, so of equal grams the leftmost anchors, wherever it stands.
BLOCK = 1 << 17
#: Bytes of text whose equal pieces a task settles by itself, and of the largest suffix array.
SLICE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 17) - 1)


class _Powers:
    """Powers of _ODD and of its inverse modulo 2 ** 64."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * BLOCK)
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _prefix_hash(b: np.ndarray) -> np.ndarray:
    up, _ = _Powers.get(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=out[1:])
    return out


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _Powers.get(len(prefix))
    return _mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[: len(x) - m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if m < width else x


def pieces(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Texts laid end to end in b, text i up to ends[i] -> (anchor, content hash, text, start in text, windows, anchor's place) of each piece.

    b has at most BLOCK bytes; the place is counted from the piece's start.
    """
    begins = np.concatenate([[0], ends[:-1]])
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    if len(b) < length:
        return none
    prefix = _prefix_hash(b)
    at = np.arange(len(b) - GRAM + 1)
    _, down = _Powers.get(len(b) + 1)
    grams = _mixed((prefix[GRAM:] - prefix[: len(at)]) * down[: len(at)])
    least = _slide((grams & ~_LOW) | (at.astype(np.uint64) & _LOW), length - GRAM + 1)
    text = np.repeat(np.arange(len(ends)), ends - begins)[: len(least)]
    whole = np.arange(len(least)) + length <= ends[text]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new & whole)
    if not len(starts):
        return none
    stops = np.flatnonzero(whole & ~np.concatenate([whole[1:] & ~new[1:], [False]])) + 1
    h = least[starts] >> np.uint64(17)
    place = (least[starts] & _LOW).astype(np.int64) - starts
    return h, _span_hash(prefix, starts, stops + length - 1), text[starts], starts - begins[text[starts]], stops - starts, place


def blocks(texts: Iterable[bytes], length: int, most: int = BLOCK) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (number of the text, start in it, bytes) of at most `most` bytes in all; every window of a text lies in one of its parts."""
    block: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), most - length + 1):
            part = text[at : at + most] if len(text) > most else text
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((i, at, part))
            size += len(part)
    if block:
        yield block


def anchored_pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, text, start in text, windows, anchor's place) of the pieces of some texts, block by block."""
    found = []
    for block in blocks(texts, length):
        number, begin = np.array([b[0] for b in block]), np.array([b[1] for b in block])
        h, content, which, start, windows, place = pieces(np.frombuffer(b"".join(b[2] for b in block), np.uint8), np.cumsum([len(b[2]) for b in block]), length)
        found.append((h, content, number[which], begin[which] + start, windows, place))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def finer(start: int, place: int, piece: bytes, length: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """A piece cut into those of its windows that hold the anchor within the same `width` places -> (key, start, place, piece) of each.

    All windows of a class hold the same bytes around the anchor, of which the key is made; equal windows
    hold it at the same place, so they have equal keys.
    """
    last = place - (len(piece) - length)
    for c in range(place // width, last // width - 1, -1):
        low, high = c * width, min(c * width + width - 1, length - GRAM)
        skip, stop = place - min(place, high), place - max(last, low) + length
        yield zlib.crc32(piece[place - low : place - high + length], c), start + skip, place - skip, piece[skip:stop]


def suffix_array(t: np.ndarray, alphabet: int, depth: int) -> np.ndarray:
    """Suffixes of t in order of their first `depth` symbols at least; t ends with its only 0.

    Induced sorting with the buckets' scans done a batch at a time: what a batch of a bucket
    induces into the same bucket is its next batch.
    """
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32)))
    nxt = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = np.concatenate([step, [1]])[nxt] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(t, minlength=alphabet)
    ends = np.cumsum(counts)
    begins = ends - counts

    def induce(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int32)
        per = np.bincount(t[order], minlength=alphabet)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(per) - per, per)
        by_symbol = order[np.argsort(t[order], kind="stable")]
        sa[np.repeat(ends - per, per) + rank] = by_symbol
        head, tail = begins.copy(), ends.copy()

        def spread(batch: np.ndarray, kind: bool) -> None:
            j = batch - 1
            j = j[j >= 0]
            j = j[smaller[j] == kind]
            if not len(j):
                return
            c = t[j]
            by = np.argsort(c, kind="stable")
            j, c = j[by], c[by]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
            size = np.diff(np.concatenate([cut, [len(c)]]))
            inner = np.arange(len(c)) - np.repeat(cut, size)
            symbols = c[cut]
            if kind:
                sa[np.repeat(tail[symbols], size) - 1 - inner] = j
                tail[symbols] -= size
            else:
                sa[np.repeat(head[symbols], size) + inner] = j
                head[symbols] += size

        for c in np.flatnonzero(counts):
            at = begins[c]
            while at < head[c]:
                at, was = head[c], at
                spread(sa[was:at], False)
            if per[c]:
                spread(sa[ends[c] - per[c] : ends[c]], False)
        for c in np.flatnonzero(counts)[::-1]:
            at = ends[c]
            while tail[c] < at:
                at, was = tail[c], at
                spread(sa[at:was][::-1], True)
            if head[c] > begins[c]:
                spread(sa[begins[c] : head[c]][::-1], True)
        sa[0] = n - 1
        return sa

    # Name the leftmost-smaller substrings in their order, then sort the string of names.
    sa = induce(lms)
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(len(lms))
    sorted_lms = place[sa][place[sa] >= 0]
    prefix = _prefix_hash(t)
    stop = np.concatenate([lms[1:] + 1, [n]])
    content = _span_hash(prefix, lms, stop)[sorted_lms]
    names = np.empty(len(lms), np.int64)
    names[sorted_lms] = np.cumsum(np.concatenate([[0], (content[1:] != content[:-1]).astype(np.int64)]))
    covered = 1
    while covered < depth and len(names) and names.max() + 1 < len(names):
        # pairs of names get names of their own, each round over twice as many symbols
        after = np.zeros(len(names), np.int64)
        after[: len(names) - covered] = names[covered:] + 1
        _, names = np.unique(names * (len(names) + 1) + after, return_inverse=True)
        covered *= 2
    return induce(lms[np.argsort(names, kind="stable")])


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in text order, the length (up to `most`) of what it shares with the suffix before it in the array.

    Only where that neighbour is not simply the neighbour of the suffix before, one further, are
    symbols compared; elsewhere the length is one less than at the position before.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    heads = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (t[:-1] != t[before[:-1]])]))
    sizes = np.diff(np.concatenate([heads, [n]]))
    reach = most + sizes
    length = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(before[heads] >= 0)
    while len(live):
        a, b = heads[live] + length[live], before[heads[live]] + length[live]
        inside = (a < n) & (b < n) & (length[live] < reach[live])
        live, a, b = live[inside], a[inside], b[inside]
        same = t[a] == t[b]
        live = live[same]
        length[live] += 1
    return np.repeat(length, sizes) - (np.arange(n) - np.repeat(heads, sizes))


def repeats(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a shard -> (doc, start, windows): runs of windows that also start earlier."""
    sizes = np.array([len(x) for x in texts])
    t = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.uint16) + 2
    begins = np.cumsum(sizes + 1) - sizes - 1
    t[begins + sizes] = 1
    t[-1] = 0
    sa = suffix_array(t, 258, length)
    shared = common_prefixes(t, sa, length)
    piece = np.full(len(t), -1, np.int64)
    windows = sizes - length + 1
    piece_of = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(piece_of)) - np.repeat(np.cumsum(windows) - windows, windows)
    piece[begins[piece_of] + offset] = piece_of
    held = piece[sa]
    klass = np.cumsum(shared[sa] < length)[held >= 0]
    ordered = sa[held >= 0]
    several = np.bincount(klass)[klass] > 1 if len(klass) else np.zeros(0, bool)
    klass, ordered = klass[several], ordered[several]
    p = piece[ordered]
    off = ordered - begins[p]
    where, when = doc[p], start[p] + off
    by = np.lexsort((when, where, klass))
    first = np.concatenate([[True], np.diff(klass[by]) != 0]) if len(by) else np.zeros(0, bool)
    lost = by[~first]
    lp, lo = p[lost], off[lost]
    by = np.lexsort((lo, lp))
    lp, lo = lp[by], lo[by]
    if not len(lp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.flatnonzero(np.concatenate([[True], (lp[1:] != lp[:-1]) | (lo[1:] != lo[:-1] + 1)]))
    return doc[lp[run]], start[lp[run]] + lo[run], np.diff(np.concatenate([run, [len(lp)]]))


def shard_repeats(key: np.ndarray, doc: np.ndarray, start: np.ndarray, place: np.ndarray, piece: list[bytes], length: int, width: int, most: int = SLICE) -> tuple[np.ndarray, ...]:
    """As `repeats`, where only pieces of one key have equal windows: by suffix arrays of at most `most` bytes.

    A key with more bytes of different pieces than half of that is cut into classes of `width` places, then of half as many,
    down to single windows, which are equal as a whole.
    """
    content = pd.factorize(pd.Series(piece, dtype=object))[0]
    sizes = np.array([len(x) for x in piece], np.int64)
    by = np.lexsort((start, doc, content, key))
    new_key = np.concatenate([[True], np.diff(key[by]) != 0]) if len(by) else np.zeros(0, bool)
    first = new_key.copy()
    first[1:] |= np.diff(content[by]) != 0
    same = by[~first]
    found = [(doc[same], start[same], sizes[same] - length + 1)]
    group = (np.cumsum(new_key) - 1)[first]
    by = by[first]
    several = np.bincount(group)[group] > 1 if len(by) else first
    by, group = by[several], np.unique(group[several], return_inverse=True)[1]
    total = np.bincount(group, weights=sizes[by] + 1).astype(np.int64) if len(by) else np.zeros(0, np.int64)
    large = total > most // 2 if width else np.zeros(len(total), bool)
    for g in np.flatnonzero(large):
        cut = [(*x, doc[i]) for i in by[group == g] for x in finer(int(start[i]), int(place[i]), piece[i], length, width)]
        keys, starts, places, parts, docs = zip(*cut, strict=True)
        found.append(shard_repeats(np.array(keys), np.array(docs), np.array(starts), np.array(places), list(parts), length, (width + 1) // 2 if width > 1 else 0, most))
    small = np.where(large, 0, total)
    batch = ((np.cumsum(small) - small) // max(1, most // 2))[group]
    by, batch = by[~large[group]], batch[~large[group]]
    for x in np.split(by, np.flatnonzero(np.diff(batch)) + 1):
        if len(x):
            found.append(repeats([piece[i] for i in x], doc[x], start[x], length))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (the order of documents), key and text as bytes.

    Where keys repeat or are missing, rows are sorted by ranges of (key, text), null keys first, and
    numbered in that order; otherwise the key is the number.
    """
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    most = d.groupBy("key").count().agg(F.max("count").alias("n"), F.bool_or(F.col("key").isNull()).alias("none")).first()
    if (most.n or 0) <= 1 and not most.none:
        return d.withColumn("doc", F.col("key"))
    # written once, so a document keeps its number; numbers grow from range to range and inside each
    return stored(d.orderBy(F.col("key").asc_nulls_first(), "text").withColumn("doc", F.monotonically_increasing_id()), "in-order")


def deduplicate(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", shard_rows: int = 250_000, shard_bytes: int = 3 << 20) -> DataFrame:
    """docs -> key, n_bytes, spans array<struct<start, end>>, kept binary; one row per row.

    spans: maximal byte ranges covered by `length`-byte strings that also start earlier; kept: the
    other bytes.  Texts count as UTF-8, null as empty; matches never cross documents; texts of
    under `length` bytes keep everything.  Rows that repeat a key are taken as later documents,
    ordered by text; a null key comes before all.  Very long texts are searched whole; an empty
    table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    d = _numbered(docs, key, text)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, math.ceil(total * 2 / (length - GRAM + 2) / shard_rows))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
                part = whole.slice(at, to - at)
                at = to
                h, content, which, start, windows, place = anchored_pieces(part.column(1).to_pylist(), length)
                where = part.column(0).to_numpy()[which]
                # equal pieces of one slice: all but the first are repeats already
                by = np.lexsort((start, where, content, h))
                again = np.zeros(len(h), bool)
                again[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (content[by[1:]] == content[by[:-1]])
                shard = np.where(again, where % shards, (h % np.uint64(shards)).astype(np.int64)).astype(np.int32)
                # a batch of bounded size, however long a text is
                columns = [shard, h.astype(np.int64), content.view(np.int64), where, start.astype(np.int32), np.where(again, -windows, windows).astype(np.int16), place.astype(np.int16)]
                for i in range(0, len(h), SLICE // GRAM):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + SLICE // GRAM]) for x in columns], ["shard", "h", "content", "doc", "start", "windows", "place"])

    def settled(g: pa.Table) -> pa.Table:
        """Repeats (h null) and pieces whose anchor has others (h set); frequent: whether these have many bytes."""
        g = g.combine_chunks()
        h, content, doc, start, windows, place = (g.column(c).to_numpy() for c in ("h", "content", "doc", "start", "windows", "place"))
        again = windows < 0
        done = (doc[again], start[again], -windows[again], place[again])
        h, content, doc, start, windows, place = (x[~again] for x in (h, content, doc, start, windows, place))
        by = np.lexsort((start, doc, content, h))
        h, content, doc, start, windows, place = (x[by] for x in (h, content, doc, start, windows, place))
        new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        first = new_h.copy()
        first[1:] |= content[1:] != content[:-1]
        kinds = np.bincount(np.cumsum(new_h)[first] - 1) if len(h) else np.zeros(0, int)
        several = first & (kinds[np.cumsum(new_h) - 1] > 1) if len(h) else first
        same = ~first
        anchors = (np.cumsum(new_h) - 1)[several]
        frequent = np.bincount(anchors, weights=windows[several] + float(length))[anchors] > shard_bytes // 8 if len(anchors) else np.zeros(0, bool)
        parts = [np.concatenate([a, b[same], b[several]]) for a, b in zip(done, (doc, start, windows, place), strict=True)]
        settled_now = len(done[0]) + int(same.sum())
        anchor = pa.concat_arrays([pa.nulls(settled_now, pa.int64()), pa.array(h[several])])
        often = np.concatenate([np.zeros(settled_now, bool), frequent])
        return pa.table({"h": anchor, "doc": parts[0], "start": parts[1].astype(np.int32), "windows": parts[2].astype(np.int16), "place": parts[3].astype(np.int16), "frequent": often})

    rows = d.select("doc", "text").mapInArrow(anchored, "shard int, h long, content long, doc long, start int, windows short, place short")
    known = stored(rows.groupBy("shard").applyInArrow(settled, "h long, doc long, start int, windows short, place short, frequent boolean"), "pieces")
    open_pieces = known.where("h is not null")
    size = open_pieces.agg(F.sum(F.when(F.col("frequent"), F.col("windows") + 4 * length).otherwise(F.col("windows") + length))).first()[0] or 0
    width = math.ceil((length - GRAM + 1) / 4)
    parts = max(1, math.ceil(size / shard_bytes))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("place", pa.int16()), ("piece", pa.binary())])
        for b in batches:
            for at in range(0, b.num_rows, 500):
                out: dict[str, list] = {k: [] for k in schema.names}
                for doc, t, found in zip(*(b.column(i).slice(at, 500).to_pylist() for i in range(3)), strict=True):
                    for x in found:
                        h, piece = x["h"], t[x["start"] : x["start"] + x["windows"] + length - 1]
                        for key, start, place, part in finer(x["start"], x["place"], piece, length, width) if x["frequent"] else [(0, x["start"], x["place"], piece)]:
                            out["shard"].append((h ^ key) % parts)
                            out["key"].append(h ^ key)
                            out["doc"].append(doc)
                            out["start"].append(start)
                            out["place"].append(place)
                            out["piece"].append(part)
                yield pa.RecordBatch.from_pydict(out, schema)

    wanted = open_pieces.groupBy("doc").agg(F.collect_list(F.struct("h", "start", "windows", "place", "frequent")).alias("found"))
    cut = d.select("doc", "text").join(wanted, "doc").select("doc", "text", "found").mapInArrow(cut_out, "shard int, key long, doc long, start int, place short, piece binary")

    def sorted_shard(g: pa.Table) -> pa.Table:
        key, doc, start, place = (g.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "start", "place"))
        doc, start, windows = shard_repeats(key, doc, start, place, g.column("piece").to_pylist(), length, width)
        return pa.table({"doc": doc, "start": start.astype(np.int32), "windows": windows.astype(np.int32)})

    more = stored(cut.groupBy("shard").applyInArrow(sorted_shard, "doc long, start int, windows int"), "repeats")
    runs = known.where("h is null").select("doc", "start", F.col("windows").cast("int")).union(more)
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out: dict[str, list] = {k: [] for k in schema.names}
                for key, t, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    spans: list[dict] = []
                    for x in sorted(found or [], key=lambda x: x["start"]):
                        end = x["start"] + x["windows"] + length - 1
                        if spans and x["start"] <= spans[-1]["end"]:
                            spans[-1]["end"] = max(spans[-1]["end"], end)
                        else:
                            spans.append({"start": x["start"], "end": end})
                    edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(t)]
                    out["key"].append(key)
                    out["n_bytes"].append(len(t))
                    out["spans"].append(spans)
                    out["kept"].append(b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_pydict(out, schema)

    out = d.join(runs, "doc", "left").select("key", "text", "runs").mapInArrow(kept, "key long, n_bytes long, spans array<struct<start long, end long>>, kept binary")
    return out.withColumnRenamed("key", key)


def brute_force(texts: dict[int, bytes], length: int) -> dict[int, tuple[int, int, int, str]]:
    """The same by definition, for tests: id -> n_bytes, n_removed, n_spans, kept_sha256."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        t = texts[i]
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
