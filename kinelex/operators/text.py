"""Tokens, vocabulary and left-right flips of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stages import stored

#: A word, or a single sign.
TOKEN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
SPECIALS = ("<pad>", "<start>", "<end>", "<unk>")

# Words that decide about flips.
FLIPS = {
    "right": "left", "rightward": "leftward", "rightwards": "leftwards", "right-hand": "left-hand", "right-facing": "left-facing",
    "right-handed": "left-handed", "righthand": "lefthand", "rightwardly": "leftwardly", "right-side": "left-side",
    "right-looking": "left-looking", "backward-right": "backward-left", "right-most": "left-most", "front-right": "front-left",
    "top-right": "top-left", "rights": "lefts", "clockwise": "counterclockwise",
}
ALSO_CLOCKWISE = ("anticlockwise", "counter-clockwise", "anti-clockwise")
GUARDS = ("o'clock", "clock", "x-axis")
DETERMINERS = ("your", "their", "his", "her", "the", "a", "an", "this", "these", "those")
AFTER_BE = ("is", "are", "it's", "isn't", "aren't", "not", "be")
ANGLES = ("angle", "angles")
PREPOSITIONS = ("about", "before", "after", "off", "between", "behind", "in", "under", "next", "below", "above", "across", "away", "near", "by", "at")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def vocabulary(texts: DataFrame, least: int = 2) -> DataFrame:
    """texts (data_id, text) -> word, idx: the special tokens, then words of `least` occurrences by where they are first seen."""
    w = texts.select("data_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    seen = w.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("data_id", "pos")).alias("first")).where(F.col("n") >= least)
    ranked = in_order(seen.select("word", "first"), "first", "word").select("word", (F.col("place") + len(SPECIALS)).alias("idx"))
    special = texts.sparkSession.createDataFrame(list(zip(SPECIALS, range(len(SPECIALS)), strict=True)), "word string, idx int")
    return special.unionByName(ranked.select("word", F.col("idx").cast("int").alias("idx")))


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """rows plus place, gapless from 0 in the order of `by`: sorted by ranges, numbered inside each, and shifted by the sizes of the ranges before."""
    ranges = stored(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = ranges.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1)
    return inside.join(starts, "__range").withColumn("place", F.col("__start") + F.col("__at")).drop("__range", "__at", "__start")


def encode(texts: DataFrame, vocab: DataFrame, longest: int = 500) -> DataFrame:
    """texts (data_id, text) -> data_id, ids, length: <start>, the words (<unk> for unknown ones), <end>, at most `longest` long."""
    w = texts.select("data_id", F.posexplode_outer(tokens(F.col("text"))).alias("pos", "word"))
    known = w.join(vocab, "word", "left").select("data_id", "pos", F.when(F.col("word").isNotNull(), F.coalesce("idx", F.lit(SPECIALS.index("<unk>")))).alias("idx"))
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("pos", "idx")))), lambda x: x["idx"])
    out = known.groupBy("data_id").agg(ids.alias("inner"))
    body = F.slice("inner", 1, longest - 2)
    return out.select("data_id", F.concat(F.array(F.lit(1)), body, F.array(F.lit(2))).alias("ids")).withColumn("length", F.size("ids"))


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """data_id, ids -> data_id, text: special tokens dropped, no space before punctuation, sentences capitalised."""
    w = encoded.select("data_id", F.posexplode("ids").alias("pos", "idx")).join(vocab, "idx").where(F.col("idx") >= len(SPECIALS))
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return w.groupBy("data_id").agg(sentence_case(F.regexp_replace(words, r" ([.,;:!?])", "$1")).alias("text"))


def sentence_case(text: Column) -> Column:
    """Each sentence starts with a capital and goes on in lower case."""
    one = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))
    return F.array_join(F.transform(F.split(text, r"\. "), one), ". ")


def flip(ts: Column) -> Column:
    """Tokens with left and right exchanged; where `right` is no side it stays.  Null where a guard word forbids flipping.

    All conditions look at the original neighbours: after a form of `be` and before an angle
    `right` stays, and before a preposition it stays unless a determiner precedes it.
    """
    pairs = [F.lit(x) for k, v in FLIPS.items() for x in (k, v)] + [F.lit(x) for k, v in FLIPS.items() if k != "clockwise" for x in (v, k)]
    pairs += [F.lit(x) for w in ("counterclockwise", *ALSO_CLOCKWISE) for x in (w, "clockwise")]
    table = F.create_map(*pairs)

    def one(t: Column, i: Column) -> Column:
        before, after = F.coalesce(F.get(ts, i - 1), F.lit("")), F.coalesce(F.get(ts, i + 1), F.lit(""))
        stays = before.isin(*AFTER_BE) | after.isin(*ANGLES) | (after.isin(*PREPOSITIONS) & ~before.isin(*DETERMINERS))
        return F.when((t == "right") & stays, t).otherwise(F.coalesce(table[t], t))

    return F.when(~F.arrays_overlap(ts, F.array(*(F.lit(g) for g in GUARDS))), F.transform(ts, one))


#: Pieces of words, as a vocabulary may hold them: `anti-clockwise` is three.
PIECE = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def flip_words() -> tuple[str, ...]:
    """Every word that decides about a flip."""
    return tuple(dict.fromkeys([*FLIPS, *FLIPS.values(), *ALSO_CLOCKWISE, *GUARDS, *DETERMINERS, *AFTER_BE, *ANGLES, *PREPOSITIONS]))


def flip_table(vocab: DataFrame, piece: str = PIECE) -> list[tuple[str, tuple[int, ...], int]]:
    """vocab (word, idx) of pieces -> (word, its ids, an id of its own beyond the vocabulary), the longest first.

    The words are a constant of this package, so their few rows of the vocabulary and its largest id
    may come to the driver.  A word with a piece that the vocabulary lacks can't occur and has no row.
    """
    import regex

    pieces = {w: regex.findall(piece, w) for w in flip_words()}
    known = {r.word: r.idx for r in vocab.where(F.col("word").isin(sorted({x for xs in pieces.values() for x in xs}))).collect()}
    beyond = vocab.agg(F.max("idx")).first()[0] + 1
    rows = [(w, tuple(known[x] for x in xs)) for w, xs in pieces.items() if all(x in known for x in xs)]
    return [(w, ids, beyond + i) for i, (w, ids) in enumerate(sorted(rows, key=lambda r: (-len(r[1]), r[0])))]


def _chained(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")


def _unchained(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda i: i.cast("int"))


def to_flip_ids(ids: Column, table: list[tuple[str, tuple[int, ...], int]]) -> Column:
    """Ids with the ids of every flip word put into one; longer words go first, so no word is broken by one inside it."""
    chain = _chained(ids)
    for _, own, one in table:
        chain = F.replace(chain, F.lit("".join(f"<{i}>" for i in own)), F.lit(f"<{one}>"))
    return _unchained(chain)


def from_flip_ids(ids: Column, table: list[tuple[str, tuple[int, ...], int]]) -> Column:
    """The vocabulary's own ids again."""
    many = F.create_map(*(x for _, own, one in table for x in (F.lit(one), F.array(*(F.lit(i) for i in own)))))
    return F.flatten(F.transform(ids, lambda i: F.coalesce(many[i], F.array(i))))


def flip_ids(ids: Column, table: list[tuple[str, tuple[int, ...], int]]) -> Column:
    """Ids of a text whose sides are exchanged by the rules of `flip`; null where a guard word forbids it.

    A word whose counterpart the vocabulary lacks stays.
    """
    word = F.create_map(*(F.lit(x) for w, _, one in table for x in (one, w)))
    back = F.create_map(*(F.lit(x) for w, _, one in table for x in (w, one)))
    one = to_flip_ids(ids, table)
    words = F.transform(one, lambda i: F.coalesce(word[i], F.concat(F.lit("#"), i.cast("string"))))
    turned = F.transform(flip(words), lambda w, k: F.coalesce(back[w], F.get(one, k)))
    return from_flip_ids(turned, table)


def coverage(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """How many vocabulary words have a pretrained vector, and how many lack one."""
    j = vocab.join(vectors.select("word").distinct().withColumn("has", F.lit(1)), "word", "left")
    return j.agg(F.count("has").alias("found"), (F.count("*") - F.count("has")).alias("missing"))
