"""Keyed draws of many pairs at once: the numbers of `exprs.digits`, made column by column in NumPy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: Draws made at once: enough for the calls not to count, and few enough for the caches (3 MB in six arrays).
AT_ONCE = 131_072
#: Bytes of text that MD5 takes in one block.
ONE_BLOCK = 55

_U = np.uint32
_CONST = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_LEFT, _RIGHT = ([np.array(f(_TURN[i // 16][i % 4]), _U) for i in range(64)] for f in (lambda s: s, lambda s: 32 - s))
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The last three steps don't touch the first word of the digest.
_STEPS = 61


def by_length(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts of each length, and those texts as rows of bytes."""
    n = np.array([len(x) for x in texts])
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        yield at, np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), size)


def draws(heads: np.ndarray, tails: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """The first four bytes of MD5 of every head + tail (rows of bytes), as blocks: first head, first tail, numbers by head and tail.

    A number compares as the first eight hexadecimal digits do.  A block holds until the next one is asked for.
    """
    lp, lt = heads.shape[1], tails.shape[1]
    if lp + lt > ONE_BLOCK:
        ends = [bytes(x) for x in tails]
        for p, head in enumerate(map(bytes, heads)):
            yield p, 0, np.array([[int.from_bytes(hashlib.md5(head + x).digest()[:4], "big") for x in ends]], _U)
        return
    wide = max(1, min(len(tails), AT_ONCE))
    high = max(1, AT_ONCE // wide)
    cols, state, lead = _of_heads(heads)
    for t in range(0, len(tails), wide):
        rows = _of_tails(tails[t : t + wide], lp)
        m = min(wide, len(tails) - t)
        whole = [np.empty((high, m), _U) for _ in range(6)]
        for p in range(0, len(heads), high):
            part = slice(p, p + high)
            n = min(high, len(heads) - p)
            adds = [[x for x in (r, c if c is None else c[part]) if x is not None] for r, c in zip(rows, cols, strict=True)]
            yield p, t, _digest(lead, [x[part] for x in state], adds, [x[:n] for x in whole])


def _of_heads(heads: np.ndarray) -> tuple[list[np.ndarray | None], list[np.ndarray], int]:
    """What heads add in each step, the state after the steps that they alone decide, and the number of those."""
    lp = heads.shape[1]
    text = np.zeros((len(heads), 64), np.uint8)
    text[:, :lp] = heads
    words = text.view("<u4").astype(_U)
    lead, part = lp // 4, lp % 4
    cols = [words[:, g, None] + _U(_CONST[i]) if g < lead else words[:, g, None].copy() if g == lead and part else None for i, g in enumerate(_WORD)]
    a, b, c, d = (np.full((len(heads), 1), x, _U) for x in _START)
    for i in range(lead):
        x = a + (d ^ (b & (c ^ d))) + cols[i]
        a, b, c, d = d, b + ((x << _LEFT[i]) | (x >> _RIGHT[i])), b, c
    return cols, [a, b, c, d], lead


def _of_tails(tails: np.ndarray, lp: int) -> list[np.ndarray | None]:
    """What tails, the padding and the constants add in each step."""
    n = lp + tails.shape[1]
    text = np.zeros((len(tails), 64), np.uint8)
    text[:, lp:n] = tails
    text[:, n] = 0x80
    words = text.view("<u4").astype(_U)
    words[:, 14] = 8 * n
    lead, last = lp // 4, n // 4
    same = lambda i, g: np.array((_CONST[i] + (8 * n if g == 14 else 0)) % 2**32, _U)
    return [None if g < lead else (words[None, :, g] + _U(_CONST[i])) if g <= last else same(i, g) for i, g in enumerate(_WORD)]


def _digest(lead: int, state: list[np.ndarray], adds: list[list[np.ndarray]], whole: list[np.ndarray]) -> np.ndarray:
    """Steps `lead` to 60 of MD5 on all heads and tails; whole: six arrays to work in."""
    xor, both, either, plus, left, right = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add, np.left_shift, np.right_shift
    f, y, *spare = whole
    a, b, c, d = state
    for i in range(lead, _STEPS):
        if i < 16:
            xor(c, d, f)
            both(f, b, f)
            xor(f, d, f)
        elif i < 32:
            xor(b, c, f)
            both(f, d, f)
            xor(f, c, f)
        elif i < 48:
            if i % 2:  # y is what b and c were in the step before
                xor(y, b, f)
            else:
                xor(b, c, y)
                xor(y, d, f)
        else:
            np.invert(d, f)
            either(f, b, f)
            xor(f, c, f)
        x = spare.pop() if spare else a
        plus(a, f, x)
        for add in adds[i]:
            plus(x, add, x)
        left(x, _LEFT[i], f)
        right(x, _RIGHT[i], x)
        either(x, f, x)
        plus(x, b, x)
        a, b, c, d = d, x, b, c
    plus(b, _U(_START[0]), f)
    return f.byteswap(inplace=True)
