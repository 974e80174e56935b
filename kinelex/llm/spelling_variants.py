"""Groups of spelling variants: words one edit apart, found by a positional q-gram index.

One edit leaves the first or the last half of a word intact.  So words are dealt by the halves they
share: a cell holds words of length m or m + 1 with the same first (or last) m // 2 code points.  A
cell of more than `most` words is dealt again by the halves of what is left between the parts that
are known to agree; in the end one code point is left, so cells are bounded by the alphabet and no
word is ever dropped.  Inside a cell the words' middles are indexed by their positional q-grams: a
word's postings, one length and one position off at most, are heap-merged, pairs with as many common
q-grams as one edit must leave are kept, and verified on the whole words.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stored

#: Code points of a gram.
Q = 2
#: Words a task counts before it hands them on.
HELD = 300_000
#: A run of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 whose A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _slipped(word: bytes, h: int) -> bytes:
    w = word.decode()
    at = h % len(w)
    return (w[:at] + w[at + 1 :]).encode()


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None) -> DataFrame:
    """docs -> word, n: the runs of letters of all whole texts, A-Z lower-cased, with their occurrences.

    slip: where the crc32 h of `<key>:<run>` is divisible by it, all the document's occurrences of
    the run lose code point h % length, as a test of variants needs them.  Null texts have no runs; a
    null key is written as an empty string; repeated rows count again; an empty table has no words.
    """
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not t.is_valid:
                    continue
                runs = RUN.findall(t.as_py().lower())
                total.update(runs)
                if slip:
                    before = zlib.crc32(f"{k or ''}:".encode())
                    for w in [w for w in set(runs) if zlib.crc32(w, before) % slip == 0]:
                        n = runs.count(w)
                        total[w] -= n
                        total[_slipped(w, zlib.crc32(w, before))] += n
                if len(total) > HELD:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def near_in_cell(words: list[str], m: int, left: int, right: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of words one edit apart, at least one of them of length m; all share `left` first and `right` last code points."""
    postings: dict[tuple[str, int], list[int]] = {}
    indexed: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        w = words[i]
        # marks on both ends, so that a middle of k code points has k + 1 grams and one edit spoils Q of them at most
        middle = f"\x00{w[left : len(w) - right]}\x01"
        grams = [(middle[p : p + Q], p) for p in range(len(middle) - Q + 1)]
        bound = len(grams) - Q
        if bound > 0:
            lists = [x for g, p in grams for o in (p - 1, p, p + 1) if (x := postings.get((g, o)))]
            found = (j for j, same in groupby(heapq.merge(*lists)) if sum(1 for _ in same) >= bound)
        else:
            found = iter(indexed)
        for j in found:
            if one_edit(w, words[j]):
                yield i, j
        if len(w) == m:
            indexed.append(i)
            for x in grams:
                postings.setdefault(x, []).append(i)


_PAIR = pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that follow each other -> pairs of near words; a cell may go on in the next batch."""
    rest: pa.Table | None = None

    def pairs(t: pa.Table, starts: list[int], stops: list[int]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        m, left, right = (t.column(c).to_pylist() for c in ("m", "left", "right"))
        words, n = t.column("word").to_pylist(), t.column("n").to_pylist()
        for s, e in zip(starts, stops, strict=True):
            if e - s > 1 and m[s] in {len(w) for w in words[s:e]}:
                for i, j in near_in_cell(words[s:e], m[s], left[s], right[s]):
                    for k, x in enumerate((words[s + i], n[s + i], words[s + j], n[s + j])):
                        out[k].append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PAIR, strict=True)], schema=_PAIR)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for c in ("cell", "m", "left", "right"):
            new |= np.diff(t.column(c).to_numpy()) != 0
        cut = [0, *(np.flatnonzero(new) + 1).tolist()]
        yield pairs(t, cut[:-1], cut[1:])
        rest = t.slice(cut[-1]) if t.num_rows else None
    if rest is not None:
        yield pairs(rest, [0], [rest.num_rows])


def _celled(word: str, m: Column, sides: list[tuple[Column, Column]]) -> Column:
    """An array of the cells of a word: length m of the shorter words, the code points that agree on the left and on the right."""
    w = F.col(word)
    return F.array(*(F.struct(m.alias("m"), left.alias("left"), right.alias("right"), F.xxhash64(m, left, right, F.substring(w, F.lit(1), left), F.right(w, right)).alias("cell")) for left, right in sides))


def near(words: DataFrame, shortest: int = 1, most: int = 512) -> DataFrame:
    """words (distinct word, n) -> every pair of words one edit apart, once: a, na, b, nb.

    shortest: words have at least so many code points, 1 at least.  Nulls and empty words have no partners.
    """
    ship(words.sparkSession)
    zero, size = F.lit(0), F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= max(1, shortest))
    rows = words.where(size > 0).select("word", "n", F.explode(lengths).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    members = rows.select("word", "n", F.explode(_celled("word", F.col("m"), [(half, zero), (zero, half)])).alias("x")).select("word", "n", "x.*").distinct()
    done, left = [], stored(members, "cells")
    while True:
        middle = F.col("m") - F.col("left") - F.col("right")
        large = stored(left.where(middle > 1).groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > most).select("cell"), "large-cells")
        if large.isEmpty():
            done.append(left)
            break
        done.append(left.join(large, "cell", "left_anti"))
        half = F.floor(middle / 2).cast("int")
        again = _celled("word", F.col("m"), [(F.col("left") + half, F.col("right")), (F.col("left"), F.col("right") + half)])
        left = stored(left.join(large, "cell", "left_semi").select("word", "n", F.explode(again).alias("x")).select("word", "n", "x.*"), "cells")
    cells = done[0]
    for more in done[1:]:
        cells = cells.unionByName(more)
    found = cells.repartition("cell").sortWithinPartitions("cell", "m", "left", "right", "word").mapInArrow(_near, "a string, na long, b string, nb long")
    pair = F.when(F.col("a") < F.col("b"), F.struct("a", "na", "b", "nb")).otherwise(F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    return found.select(pair.alias("p")).select("p.*").distinct()


def variants(words: DataFrame, shortest: int = 1, ratio: int = 2, most: int = 512) -> DataFrame:
    """words (distinct word, n) -> word, n, n_near, form, form_n, root; a row per word.

    n_near: words one edit away.  form: the most frequent of them, of equals the smallest in
    code-point order, if it is at least `ratio` times as frequent, else null (and form_n).  root: the
    last word that forms lead to, the word itself where it has none.  An empty table gives an
    empty result.
    """
    links = stored(near(words, shortest, most), "near-words")
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m"))))
    best = links.select(ends.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("own"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("x"))
    is_form = -F.col("x.m") >= ratio * F.col("own")
    best = stored(best.select("word", "n_near", F.when(is_form, F.col("x.other")).alias("form"), F.when(is_form, -F.col("x.m")).alias("form_n")), "forms")
    # forms grow in frequency, so paths end; each round doubles the steps that a word has gone
    roots, changed = best.where("form is not null").select("word", F.col("form").alias("root")), True
    while changed:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        changed = not roots.where("moved").isEmpty()
        roots = roots.drop("moved")
    out = words.select("word", "n").join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def brute_force(counted: dict[str, int], ratio: int = 2) -> list[tuple[str, int, int, str | None, int | None, str]]:
    """The same by definition, for tests: word, n, n_near, form, form_n, root of each word."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, was = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[j] + 1, was[j + 1] + 1, was[j] + (x != y)))
        return row[-1]

    others = {w: [v for v in counted if abs(len(v) - len(w)) <= 1 and distance(w, v) == 1] for w in counted}
    form = {w: min(vs, key=lambda v: (-counted[v], v)) for w, vs in others.items() if vs}
    form = {w: v for w, v in form.items() if counted[v] >= ratio * counted[w]}

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return [(w, n, len(others[w]), form.get(w), counted[form[w]] if w in form else None, root(w)) for w, n in counted.items()]
