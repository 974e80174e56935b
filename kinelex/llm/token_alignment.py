"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers spell the same bytes, so token ends are running sums of token sizes on one axis.
Offsets where tokens of both end cut the text into groups; a token's group is found by binary
search, and every token is repeated once for each token of the other side that its bytes touch.

Texts are taken in blocks of bounded size.  A block hands on each distinct pair of ids once, with
the number of its documents that hold it; these numbers are added in two salted stages, and each
block gets back the figures of its own pairs only.  So neither the corpus's pairs nor a very
frequent pair gathers in one place.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stored

#: Bytes of text that are aligned at a time; a longer text is a block of its own.
BLOCK = 1 << 20
#: A pair's counts are first added within so many salts.
SALTS = 16

# The split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes follow from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """A tokenizer: ids of texts, and the bytes that each id stands for."""

    spelled: list[bytes]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of space + text, without special tokens."""
        raise NotImplementedError

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.spelled], np.int64)


class ByteLevel(Tokens):
    """A byte-level BPE file of the tokenizers library.

    Where ids follow the order of merges, as they do in files of this kind, the file's entries are
    merge ranks, and the faster library that takes ranks gives the same ids; otherwise the file's own library runs.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, of = described["model"], byte_of()
        vocab: dict[str, int] = model["vocab"]
        special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.spelled = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        ranks = {}
        for entry, i in vocab.items():
            if entry not in special:
                self.spelled[i] = bytes(of[c] for c in entry)
                ranks[self.spelled[i]] = i
        merged = [vocab["".join(x) if isinstance(x, list) else x.replace(" ", "", 1)] for x in model["merges"]]
        pre = described["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not described["normalizer"]
        if plain and merged == sorted(merged) and len(ranks) == len(merged) + 256:
            import tiktoken

            ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._ids = lambda texts: [ranked.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self._ids = lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._ids([" " + t for t in texts])


class Pieces(Tokens):
    """A sentencepiece model that puts a space before the text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.spelled = [bytes.fromhex(byte.fullmatch(p)[1]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def load(path: str) -> Tokens:
    return (Pieces if path.endswith(".model") else ByteLevel)(path)


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common cuts of two rows of token ends, and the group of each token of either."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def overlaps(ends_a: np.ndarray, sizes_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens (index in a, index in b) whose bytes overlap, in order."""
    first = np.searchsorted(ends_b, ends_a - sizes_a, "right")
    n = np.searchsorted(ends_b, ends_a) - first + 1
    before = np.cumsum(n) - n
    return np.repeat(np.arange(len(ends_a)), n), np.repeat(first - before, n) + np.arange(n.sum())


@cache
def _written(n: int) -> list[str]:
    """Decimal ids, each followed by one of the three separators."""
    return [f"{i}{mark}" for i in range(n) for mark in ",|;"]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
    return flat, n


def _groups(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, most: int) -> tuple[list[str], np.ndarray]:
    """Both sides' tokens as strings in the order of their groups, side a first, and the place of each token of a and b there."""
    n = int(ga[-1]) + 1 if len(ga) else 0
    in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[ga]
    at_b = np.arange(len(b)) + np.cumsum(in_a)[gb]
    code = np.empty(len(a) + len(b), np.int64)
    code[at_a], code[at_b] = a * 3, b * 3
    code[at_a[np.cumsum(in_a) - 1]] += 1
    code[at_b[np.cumsum(in_b) - 1]] += 2
    return list(map(_written(most).__getitem__, code.tolist())), np.cumsum(in_a + in_b)


_SCHEMA = "block long, key string, n_a long, n_b long, n_groups long, n_links long, groups string, at array<int>, times array<int>, pairs array<struct<a:int,b:int,docs:long>>"
_ARROW = pa.schema([
    ("block", pa.int64()), ("key", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())]))),
])


def _decoded(t: bytes | None) -> str | None:
    try:
        return t.decode() if t else None
    except UnicodeDecodeError:
        return None


def block_rows(block: int, keys: list[str | None], texts: list[bytes | None], a: Tokens, b: Tokens, digest: bool) -> pa.Table:
    """A row per document, with the places of its pairs among the block's, and a last row with the block's pairs."""
    said = [_decoded(t) for t in texts]
    live = [i for i, t in enumerate(said) if t]
    if live:
        ids_a, ids_b = (x.encode([said[i] for i in live]) for x in (a, b))
        same = [all(b"".join(map(x.spelled.__getitem__, ids)) == b" " + texts[i] for x, ids in ((a, ia), (b, ib))) for i, ia, ib in zip(live, ids_a, ids_b, strict=True)]
        live, ids_a, ids_b = ([x for x, ok in zip(xs, same, strict=True) if ok] for xs in (live, ids_a, ids_b))
    n = len(texts)
    figures = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    groups, at, times, pairs = [""] * n, [None] * n, [None] * n, []
    if live:
        (fa, na), (fb, nb) = _flat(ids_a), _flat(ids_b)
        ends_a, ends_b = np.cumsum(a.sizes[fa]), np.cumsum(b.sizes[fb])
        cuts, ga, gb = labels(ends_a, ends_b)
        ia, ib = overlaps(ends_a, a.sizes[fa], ends_b)
        doc = np.repeat(np.arange(len(live)), na)[ia]
        wide = len(b.spelled)
        key, count = np.unique(doc * (len(a.spelled) * wide) + fa[ia] * wide + fb[ib], return_counts=True)
        doc_of, pair_of = np.divmod(key, len(a.spelled) * wide)
        known, place = np.unique(pair_of, return_inverse=True)
        pairs = [{"a": x // wide, "b": x % wide, "docs": c} for x, c in zip(known.tolist(), np.bincount(place).tolist(), strict=True)]
        last_a = np.cumsum(na) - 1
        figures["n_a"][live], figures["n_b"][live] = na, nb
        figures["n_groups"][live] = np.diff(ga[last_a] + 1, prepend=0)
        figures["n_links"][live] = np.bincount(doc, minlength=len(live))
        parts, upto = _groups(fa, fb, ga, gb, max(len(a.spelled), wide))
        stops = upto[ga[last_a]].tolist()
        cut = np.searchsorted(doc_of, np.arange(len(live) + 1)).tolist()
        place, count = place.astype(np.int32), count.astype(np.int32)
        for k, (i, start, stop) in enumerate(zip(live, [0, *stops[:-1]], stops, strict=True)):
            written = "".join(parts[start:stop])[:-1]
            groups[i] = hashlib.sha256(written.encode()).hexdigest() if digest else written
            at[i], times[i] = place[cut[k] : cut[k + 1]], count[cut[k] : cut[k + 1]]
    none = [None]
    columns = [[block] * (n + 1), keys + none, *([*figures[k].tolist(), None] for k in figures), groups + none, at + none, times + none, [None] * n + [pairs]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """docs -> key, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups (string); a row per row.

    a, b: files of the tokenizers, the same path on all executors; a name that ends in .model is a
    sentencepiece model, any other a byte-level BPE file.  Each text is encoded whole after a space.
    A link is a pair of an A and a B token whose bytes overlap; a pair of ids counts the documents
    (rows) in which it is linked; n_best: links whose pair has its A id's highest count, ties
    included; count_sum: the counts of all links.  groups: `a1,a2|b1;a3|b2,b3`, decimal ids between the
    common cuts, or with `digest` the SHA-256 of that text in lower-case hexadecimal digits.
    Null and empty texts, and texts that either tokenizer can't spell back, have no tokens: zeros and
    an empty string.  A null key stays; repeated rows count as documents of their own; very long texts
    are aligned whole, each in a block of its own; an empty table gives an empty result; no other
    column is read.
    """
    ship(docs.sparkSession)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, block = load(a), load(b), TaskContext.get().partitionId() << 32
        for x in batches:
            keys, texts = x.column(0).to_pylist(), x.column(1).to_pylist()
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to] or b"") <= BLOCK):
                    size += len(texts[to] or b"")
                    to += 1
                yield from block_rows(block, keys[at:to], texts[at:to], first, second, digest).to_batches()
                block, at = block + 1, to

    kind = docs.schema[key].dataType
    rows = stored(docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(aligned, _SCHEMA), "aligned")
    held = rows.select("block", F.posexplode("pairs").alias("i", "x")).select("block", "i", "x.a", "x.b", "x.docs")
    salted = held.groupBy("a", "b", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counts = salted.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # an A id has at most as many pairs as tokenizer B has ids
    counts = stored(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a"))), "pairs")
    own = held.join(counts, ["a", "b"]).select(F.col("block").alias("home"), "i", "count", "best")

    def summed(mine: pa.Table, figures: pa.Table) -> pa.Table:
        """Adds the figures of the block's pairs up for each of its documents."""
        count, best = np.zeros(figures.num_rows, np.int64), np.zeros(figures.num_rows, np.int64)
        i = figures.column("i").to_numpy()
        count[i], best[i] = figures.column("count").to_numpy(), figures.column("best").to_numpy()
        sums, bests = np.zeros(mine.num_rows, np.int64), np.zeros(mine.num_rows, np.int64)
        at, times = mine.column("at"), mine.column("times")
        for k in range(mine.num_rows):
            if at[k].is_valid:
                where, n = at[k].values.to_numpy(), times[k].values.to_numpy()
                sums[k], bests[k] = (count[where] * n).sum(), (best[where] * n).sum()
        out = mine.select(["key", "n_a", "n_b", "n_groups", "n_links"])
        return out.append_column("n_best", pa.array(bests)).append_column("count_sum", pa.array(sums)).append_column("groups", mine.column("groups"))

    mine = rows.where("pairs is null").drop("pairs")
    out = mine.groupBy("block").cogroup(own.groupBy("home")).applyInArrow(summed, "key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def brute_force(texts: list[str | None], a: Tokens, b: Tokens) -> list[tuple[int, int, int, int, int, int, str]]:
    """The same by definition, for tests: n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each text."""
    found = []
    for t in texts:
        ids = [x.encode([t])[0] if t else [] for x in (a, b)]
        if any(b"".join(x.spelled[i] for i in own) != b" " + (t or "").encode() for x, own in zip((a, b), ids, strict=True)):
            ids = [[], []]
        spans = []
        for x, own in zip((a, b), ids, strict=True):
            at, out = 0, []
            for i in own:
                out.append((i, at, at + len(x.spelled[i])))
                at = out[-1][2]
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [[",".join(str(i) for i, _, e in side if lo < e <= hi) for side in spans] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found.append((ids, links, groups))
    counts: dict[tuple[int, int], int] = {}
    for _, links, _ in found:
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
    best: dict[int, int] = {}
    for (i, _), c in counts.items():
        best[i] = max(best.get(i, 0), c)
    return [
        (len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), ";".join("|".join(g) for g in groups))
        for ids, links, groups in found
    ]
