"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary file is public and only read.  A word is merged by asking the tree's root for
the leftmost pair of lowest rank; a merge changes at most three leaves, each in logarithmic
time.  Words repeat, so each worker keeps a bounded table of words it has already merged.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

NONE = 1 << 62
#: Words kept per worker with their ids; the table is emptied when it is full.
CACHE = 400_000
#: In texts of these characters alone Python's own `re` and `split` see what the tokenizer's pattern sees.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]")
_PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ž]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-ž]+")


# What Unicode 16, by which the tokenizer library goes, adds to Python's 15.1.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
#: First and last capital, and the distance to its small letter.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
_CAPITALS = {c: chr(c + by) for first, last, by in NEW_CAPITALS for c in range(first, last + 1)}


def _class(kind: str, more: tuple[tuple[int, int], ...]) -> str:
    """The code points of a general category as ranges of a character class."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*runs, *more])


@cache
def any_word() -> re.Pattern:
    """The pre-tokenizer's pattern: contractions, letters, single numbers, other signs."""
    letters, numbers = _class("L", NEW_LETTERS), _class("N", NEW_NUMBERS)
    spaces = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


def lower(text: str) -> str:
    """Lower case character by character: no rule for a final sigma."""
    return "".join(c.lower() for c in text.translate(_CAPITALS))


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies show for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Codec:
    """One vocabulary: encodes texts to ids and ids back to the decoder's text."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.added).items()}
        chars = byte_chars()
        #: Ids of each byte inside a word and at its end; a vocabulary of this kind has all of them.
        self.inner, self.last = [ids[c] for c in chars], [ids[c + suffix] for c in chars]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id << 20 | right id) -> rank, and rank -> merged id.
        self.ranks = {ids[x] << 20 | ids[y]: r for r, (x, y) in enumerate(pairs)}
        self.merged = [ids[x + y] for x, y in pairs]
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token.

        Leaves of the tree are rank * n + position of each adjacent pair (NONE where there is no
        merge), inner nodes minima: the root is the leftmost pair of lowest rank.
        """
        inner, ranks = self.inner, self.ranks
        part = [inner[b] for b in word.encode()]
        part[-1] = self.last[word.encode()[-1]]
        n = len(part)
        if n == 1:
            return tuple(part)
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(part[i] << 20 | part[i + 1])
            if rank is not None:
                tree[size + i] = rank * n + i
        for i in range(size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x < y else y
        after, before = [*range(1, n), n], [-1, *range(n - 1)]

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            tree[i] = value
            while i > 1:
                low = tree[i ^ 1]
                low = low if low < value else value
                i >>= 1
                if tree[i] == low:
                    return
                tree[i] = value = low

        while (low := tree[1]) < NONE:
            rank, i = divmod(low, n)
            j = after[i]
            k = after[j]
            part[i], part[j], after[i] = self.merged[rank], -1, k
            if k < n:
                before[k] = i
                if tree[size + j] < NONE:
                    put(j, NONE)
                rank = ranks.get(part[i] << 20 | part[k])
                put(i, NONE if rank is None else rank * n + i)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                rank = ranks.get(part[h] << 20 | part[i])
                value = NONE if rank is None else rank * n + h
                if tree[size + h] != value:
                    put(h, value)
        return tuple(p for p in part if p >= 0)

    def word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            got = self.merge(word)
            if len(word) <= 40:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[word] = got
        return got

    def _part(self, text: str) -> list[int]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        plain = _PLAIN.search(text) is None
        low = text.lower() if plain else lower(text)
        known, word = self.known, self.word
        return [i for w in (_PLAIN_WORD if plain else any_word()).findall(low) for i in (known.get(w) or word(w))]

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if "<|" not in text:
            return self._part(text)
        out: list[int] = []
        for part in self.split_added.split(text):
            out += [self.added[part]] if part in self.added else self._part(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """No decoder is set in this kind of file: tokens joined by spaces, specials kept."""
        return " ".join(map(self.tokens.__getitem__, ids))


#: A task's worker is used for many tasks; it reads a vocabulary once.
_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    name = hashlib.md5(spec.encode()).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(spec)
    return _codecs[name]


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", rows: int = 256) -> DataFrame:
    """docs -> id, ids array<int>, decoded string; one row per row, in a single pass without a shuffle.

    Null and empty texts: no ids and an empty decoded text.  Texts of any length are encoded whole;
    repeated rows are encoded alike; an empty table gives an empty result; other columns are not read.  The vocabulary (bounded: one file) goes to the tasks as a broadcast.
    """
    ship(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                ids = [own.encode(t) for t in b.column(1).to_pylist()]
                decoded = pa.array(map(own.decode, ids), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), decoded], ["id", "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, ids array<int>, decoded string")
