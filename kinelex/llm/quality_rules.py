"""Line-first quality rules (DataFrame functions only).

Each line is judged by itself: navigation, symbol, shouting, punctuation and boilerplate
rules.  Failing lines go, and a document that loses more than `max_loss` of its words goes
as a whole.  All of it is an expression over one row: nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WHOLE, let, packed, stored, without, words

SYMBOLS = "#*$%&|<>"
#: Lines with one of these, in any case, are boilerplate, whatever else they say.
PHRASES = (
    "all rights reserved", "licensed under", "is licensed", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "accept cookies", "enable javascript", "lorem ipsum", "click here", "sign up for", "subscribe to our",
)
BOILERPLATE = f"(?i)({'|'.join(PHRASES)})"
BARS = "|»›•"
TERMINAL = r"[.!?\x{2026}\x{3002}]"
TERMINAL_RE2 = r"[.!?…。]"


def _has_phrase(text: Column) -> Column:
    return let(F.lower(text), lambda x: reduce(lambda a, p: a | x.contains(p), PHRASES[1:], x.contains(PHRASES[0])))


def line_fails(line: Column, n: Column, bars: Column | None = None, symbols: Column | None = None, phrase: Column | None = None) -> Column:
    """Which lines, of n words, fail.  Lines without a word never do: they carry nothing to lose.

    navigation: two or more separators, one per five words at least;
    symbols: one symbol or more per two words;
    shouting: over half of the letters are capitals, in three words or more;
    punctuation: no sentence ends anywhere in a line of three words or more;
    boilerplate: a stock phrase of licences, cookies or newsletters.

    bars, symbols, phrase: whether the line's text has any; where it has none, its lines aren't searched.
    """
    some = lambda known: F.lit(True) if known is None else known
    n_bars = F.length(line) - F.length(without(line, BARS))
    marks = F.octet_length(line) - F.octet_length(without(line, SYMBOLS))
    capitals, letters = F.regexp_count(line, F.lit(r"\p{Lu}")), F.regexp_count(line, F.lit(r"\p{L}"))
    navigation = some(bars) & let(n_bars, lambda k: (k >= 2) & (k * 5 >= n))
    symbol = some(symbols) & (marks * 2 >= n)
    shouting = (n >= 3) & line.rlike(r"\p{Lu}\p{Lu}") & (capitals * 2 > letters)
    punctuation = (n >= 3) & ~line.rlike(TERMINAL)
    return (n > 0) & (punctuation | navigation | symbol | shouting | (some(phrase) & _has_phrase(line)))


def _with_repeat_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """df without the array of its words, plus the number of words inside a three-word window that occurs twice or more, the first included.

    Texts whose window hashes are all different are done.  Others sort their hashes, cut short
    to make room for the position; equal neighbours are candidates, of which the whole hashes
    decide.  The union of the repeated windows' spans is summed over their sorted positions.
    """
    room = 30  # bits of a position: a text has under 2 ** 30 words
    w = F.col(words)
    at = F.when(F.size(w) > 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__h", F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).drop(words)
    h = F.col("__h")
    packed = F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, room), room).bitwiseOR(i.cast("long")))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(packed)))
    s = F.col("__s")

    def candidates(x: Column, k: Column) -> Column:
        near = lambda i: F.shiftright(F.get(s, i).bitwiseXOR(x), room) == 0
        return near(k - 1) | near(k + 1)

    def place(x: Column) -> Column:
        i = x.bitwiseAND(F.lit((1 << room) - 1)).cast("int")
        return F.struct(F.get(h, i).alias("h"), i.alias("i"))

    df = df.withColumn("__c", F.sort_array(F.transform(F.filter(s, candidates), place))).drop("__s", "__h")
    c = F.col("__c")
    same = lambda x, k: F.coalesce(F.get(c, k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("__p", F.sort_array(F.transform(F.filter(c, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))).drop("__c")
    p = F.col("__p")
    spans = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return df.withColumn(name, F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("__p")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept", "cleaned")


def judge(docs: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
    base_failed, kept and cleaned.

    Null, empty and blank texts have no words and fail the base rule (under 50 words); texts of any
    length are judged whole.  Columns of `docs` with one of these names are replaced, all others
    come back as they are.  Repeated rows are judged alike; an empty table gives an empty result.
    To filter by the verdict, store the result first (see `keep_clean`).
    """
    judged = _judged(docs.select(packed(docs), F.col(f"`{text}`").cast("string").alias("text")), max_loss)
    return judged.select(*(F.col(f"{WHOLE}.`{c}`").alias(c) for c in docs.columns if c not in FIGURES), *FIGURES)


def _judged(rows: DataFrame, max_loss: float) -> DataFrame:
    """Packed rows and their text, with the figures."""
    t = F.coalesce(F.col("text"), F.lit(""))
    out = rows.withColumns(
        {
            "word_chars": F.length(without(t, SPACES)).cast("long"),
            "n_symbols": (F.octet_length(t) - F.octet_length(without(t, SYMBOLS))).cast("long"),
            "__bars": F.octet_length(without(t, BARS)) < F.octet_length(t),
            "__phrase": reduce(lambda a, p: a | F.lower(t).contains(p), PHRASES[1:], F.lower(t).contains(PHRASES[0])),
            "__lines": F.split(t, "\n"),
            "__words": F.transform(F.split(t, "\n"), words),  # by line: no word crosses a line's end
        }
    )

    def verdict(line: Column, i: Column) -> Column:
        n = F.size(F.get(F.col("__words"), i))
        return let(n, lambda n: F.struct(line.alias("line"), n.alias("n"), line_fails(line, n, F.col("__bars"), F.col("n_symbols") > 0, F.col("__phrase")).alias("fails")))

    out = out.withColumn("__v", F.transform("__lines", verdict)).withColumn("__words", F.flatten("__words")).drop("__lines", "__bars", "__phrase")
    v = F.col("__v")
    with_word = F.transform(F.filter(v, lambda x: x["n"] > 0), lambda x: x["line"])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_dup_lines": let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "lost_words": total(F.filter(v, lambda x: x["fails"])),
            "cleaned": F.array_join(F.transform(F.filter(v, lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
        }
    ).drop("__v")
    out = _with_repeat_words(out, "__words", "n_repeat_words")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_loss * F.col("n_words")))


def keep_clean(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """The documents that pass, with their failing lines removed and n_chars (if any) brought up to date.

    Null, empty and blank texts have no words, so they go; rows with null in other columns and
    repeated rows are judged by their text alone; an empty table gives an empty result; the
    columns of `docs` come back as they are, whatever their names.

    The verdicts are written to the shared folder before they filter: a filter on top of `judge`
    would be pushed below it and repeat its arrays inside every lambda.
    """
    judged = _judged(docs.select(packed(docs), F.col("text").cast("string").alias("text")), max_loss)
    rest = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    kept = judged.select(*(F.col(f"{WHOLE}.`{c}`").alias(at) for c, at in rest.items()), "kept", F.when(F.col("kept"), F.col("cleaned")).alias("cleaned"))
    back = {c: F.col(at) for c, at in rest.items()} | {"text": F.col("cleaned")}
    if "n_chars" in rest:
        back["n_chars"] = F.length("cleaned").cast(dict(docs.dtypes)["n_chars"])
    return stored(kept, "quality").where("kept").select(*(back[c].alias(c) for c in docs.columns))
