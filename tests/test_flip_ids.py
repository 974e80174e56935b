"""Single ids for words of several pieces, there and back, and flips of such ids, against plain Python."""

from __future__ import annotations

import regex
from pyspark.sql import functions as F

from conftest import SF_DIR
from kinelex.operators import text
from kinelex.plans import text_queries


def flipped(words):
    """The rules of flips on whole words."""
    table = {**text.FLIPS, **{v: k for k, v in text.FLIPS.items() if k != "clockwise"}, "counterclockwise": "clockwise", **dict.fromkeys(text.ALSO_CLOCKWISE, "clockwise")}
    if set(words) & set(text.GUARDS):
        return None
    out = []
    for i, w in enumerate(words):
        before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
        stays = before in text.AFTER_BE or after in text.ANGLES or (after in text.PREPOSITIONS and before not in text.DETERMINERS)
        out.append(w if w == "right" and stays else table.get(w, w))
    return out


def joined(pieces, known):
    """Pieces put into flip words, the longest words first, as ids would be."""
    words = list(pieces)
    for w in sorted(known, key=lambda w: (-len(known[w]), w)):
        i = 0
        while i < len(words):
            if words[i : i + len(known[w])] == known[w] and len(known[w]) > 1:
                words[i : i + len(known[w])] = [w]
            i += 1
    return words


def test_all_texts(spark):
    texts = {r.id: r.text.lower() for r in text_queries.flip_texts(spark, SF_DIR).collect()}
    pieces = {i: regex.findall(text.PIECE, t) for i, t in texts.items()}
    vocab = {w: n for n, w in enumerate(sorted({p for ps in pieces.values() for p in ps}, key=lambda w: w.encode()))}
    known = {w: ps for w in text.flip_words() for ps in [regex.findall(text.PIECE, w)] if all(p in vocab for p in ps)}
    n = {"None": 0, "turned": 0}
    for r in text_queries.flip_ids(spark, SF_DIR).collect():
        ps = pieces[r.id]
        assert r.ids == " ".join(str(vocab[p]) for p in ps) and r.round_trip
        words = joined(ps, known)
        assert r.n_one == len(words)
        want = flipped(words)
        if want is None:
            n["None"] += 1
            assert r.flipped is None
        else:
            back = [p for w, was in zip(want, words, strict=True) for p in (known[w] if w in known else known.get(was, [was]) if w != was else [w])]
            n["turned"] += want != words
            assert r.flipped == " ".join(str(vocab[p]) for p in back)
    assert all(n.values())


def test_longest_word_first(spark):
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(["anti", "-", "clockwise", "right", "left", "the", "x"])], "word string, idx int")
    table = text.flip_table(vocab)
    rows = spark.createDataFrame([([0, 1, 2, 2, 1, 3],), ([5, 3, 6],), ([],), ([2, 2],)], "ids array<int>")
    got = [tuple(r) for r in rows.select(F.size(text.to_flip_ids(F.col("ids"), table)), text.from_flip_ids(text.to_flip_ids(F.col("ids"), table), table), text.flip_ids(F.col("ids"), table)).collect()]
    # counterclockwise isn't in this vocabulary, so clockwise stays; anti-clockwise becomes clockwise
    assert got == [(4, [0, 1, 2, 2, 1, 3], [2, 2, 1, 4]), (3, [5, 3, 6], [5, 4, 6]), (0, [], []), (2, [2, 2], [2, 2])]
