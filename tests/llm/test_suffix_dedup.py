"""Frequent phrases, long texts and suffix arrays of bounded size in the exact substring dedup."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from kinelex.llm import suffix_dedup

PHRASE = b"the same forty bytes stand in all of them"


def noise(r: random.Random, n: int) -> bytes:
    return bytes(r.choices(b"abcdefgh", k=n))


def around_phrase(n: int, seed: int, far: int = 68) -> list[bytes]:
    """Texts with one phrase in surroundings of which some come back, whole or on one side."""
    r = random.Random(seed)
    sides = [noise(r, far) for _ in range(n // 3)]
    side = lambda: r.choice(sides) if r.random() < 0.5 else noise(r, far)
    return [side() + PHRASE + side() for _ in range(n)]


def windows_lost(found) -> set[tuple[int, int]]:
    return {(int(d), int(s) + i) for d, s, w in zip(*found, strict=True) for i in range(int(w))}


def shard_of(texts: list[bytes], length: int = 100):
    """Arguments of a shard that holds the pieces of all texts: key, doc, start, place, piece."""
    h, _, doc, start, windows, place = suffix_dedup.anchored_pieces(texts, length)
    piece = [texts[d][s : s + w + length - 1] for d, s, w in zip(doc, start, windows, strict=True)]
    return h.astype(np.int64), doc, start, place, piece


@pytest.mark.parametrize("most", [1 << 20, 20_000, 1])
def test_bounded_suffix_arrays_find_the_same_windows(most):
    texts = around_phrase(400, 1) + [b"a" * 300, b"a" * 250 + b"b", b"ab" * 200] + around_phrase(3, 1)
    key, doc, start, place, piece = shard_of(texts)
    want = windows_lost(suffix_dedup.repeats(piece, doc, start, 100))
    assert want and windows_lost(suffix_dedup.shard_repeats(key, doc, start, place, piece, 100, 18, most)) == want


def test_a_frequent_phrase_needs_little_memory():
    key, doc, start, place, piece = shard_of(around_phrase(20_000, 2))

    def peak(work) -> tuple[float, set]:
        tracemalloc.start()
        found = work()
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, windows_lost(found)

    whole, want = peak(lambda: suffix_dedup.repeats(piece, doc, start, 100))
    bounded, got = peak(lambda: suffix_dedup.shard_repeats(key, doc, start, place, piece, 100, 18))
    assert got == want and bounded < whole / 2


def test_equal_windows_hold_their_anchor_at_the_same_place_in_long_texts():
    r = random.Random(3)
    long = noise(r, 3 * suffix_dedup.BLOCK)
    texts = [long, noise(r, 777) + long, b"x" * (suffix_dedup.BLOCK + 500), long[suffix_dedup.BLOCK - 70 : suffix_dedup.BLOCK + 70]]
    assert all(sum(len(x[2]) for x in block) <= suffix_dedup.BLOCK for block in suffix_dedup.blocks(texts, 100))
    seen: dict[bytes, set] = {}
    n = 0
    for h, d, s, p, piece in zip(*shard_of(texts), strict=True):
        for i in range(len(piece) - 99):
            seen.setdefault(piece[i : i + 100], set()).add((int(h), int(p) - i))
            n += 1
    assert n == sum(len(t) - 99 for t in texts) and all(len(x) == 1 for x in seen.values())


def test_frequent_phrases_in_small_shards_agree_with_brute_force(spark):
    r = random.Random(4)
    parts = around_phrase(600, 5, far=40) + [noise(r, 60) for _ in range(60)]
    texts = {i: b" ".join(r.choice(parts) for _ in range(r.randint(1, 9))) for i in range(300)}
    texts |= {300: texts[7] * 400, 301: b"a" * 500, 302: texts[9][1:] + b"a" * 400}
    docs = spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    out = suffix_dedup.deduplicate(docs, shard_bytes=4000).collect()
    want = suffix_dedup.brute_force(texts, 100)
    assert len(out) == len(want)
    for x in out:
        assert (x.n_bytes, x.n_bytes - len(x.kept), len(x.spans)) == want[x.doc_id][:3]
