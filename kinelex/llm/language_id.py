"""Language identification with interpolated Kneser-Ney character models.

Texts become letters and boundaries (any run of other characters).  The tasks count the n-grams
of ORDER characters of every training text; all shorter orders, their continuation counts and
the smoothed log probabilities follow by grouping and joining on the grams themselves, so the
model is a table that grows with the corpus and merges no two grams.  To score, a few languages'
tables at a time become sorted hash arrays, as many as fit `model_bytes`; every such group takes
one pass over the texts, and a text goes to the language of lowest cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stored

ORDER = 4
DISCOUNT = 0.75
NONE = "und"
#: The boundary, and the characters of text that a task works on at a time.
GAP, SLICE = 32, 1 << 20
#: Distinct grams that a task counts before it hands them on.
HELD = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _chars(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts and each one's row; every text starts and ends with a boundary."""
    joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(points == 10) - (points == 10)
    known = _letters()[points]
    ends = np.flatnonzero(points == 10)
    first = np.zeros(len(points), bool)
    first[np.concatenate([[0], ends[:-1] + 1])] = True
    # a text that starts with a letter gets its boundary from the end of the one before
    keep = known | np.concatenate([[True], known[:-1]]) | first
    letters, row = np.where(known, points, GAP)[keep], row[keep]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
    bare = starts[letters[starts] != GAP]
    return np.insert(letters, bare, GAP), np.insert(row, bare, row[bare])


def _grams(chars: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The ORDER characters up to each position, boundaries before a text's start; a row per position."""
    start = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
    position = np.arange(len(chars)) - np.repeat(start, np.diff(np.concatenate([start, [len(chars)]])))
    out = np.full((len(chars), ORDER), GAP, np.uint32)
    for back in range(ORDER):
        c = np.full(len(chars), GAP, np.uint32)
        c[back:] = chars[: len(chars) - back]
        c[position < back] = GAP
        out[:, ORDER - 1 - back] = c
    return out


def _hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of grams of one length, a row each; of no characters: one constant."""
    h = np.full(len(grams), 0x9E3779B97F4A7C15 + grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = (h ^ grams[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _events(chars: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions that are predicted: letters, and the boundaries that follow one."""
    after = np.concatenate([[False], (chars[:-1] != GAP) & (row[1:] == row[:-1])])
    return np.flatnonzero((chars != GAP) | after)


def _strings(grams: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(grams.astype(np.uint32))
    return pa.array(flat.view(f"<U{grams.shape[1]}").reshape(-1).tolist() if len(flat) else [], pa.string())


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> lang, gram, n: partial counts of the grams of ORDER characters."""
    held: dict[str, list] = {}

    def drain(lang: str) -> pa.RecordBatch:
        grams, n = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
        _, first, inverse = np.unique(_hash(grams), return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), _strings(grams[first]), pa.array(np.bincount(inverse, weights=n).astype(np.int64))], ["lang", "gram", "n"])

    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            for a, z in _parts(own):
                chars, row = _chars(own[a:z])
                grams = _grams(chars, row)[_events(chars, row)]
                _, first, n = np.unique(_hash(grams), return_index=True, return_counts=True)
                held.setdefault(lang, []).append((grams[first], n))
            if sum(len(g) for g, _ in held.get(lang, [])) > HELD:
                yield drain(lang)
    for lang in sorted(held):
        yield drain(lang)


def counts(rows: DataFrame) -> DataFrame:
    """rows (lang, text) -> lang, gram, n over all texts."""
    return rows.select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def smoothed(counted: DataFrame, n_chars: int) -> DataFrame:
    """counts -> lang, gram, logp, back: per gram of 1 to ORDER characters the log probability of its last
    character after the others, and per gram that is a context the log weight left to shorter ones.

    Below the highest order a gram counts once for each distinct character before it.  A window
    over a context holds one row per character that follows it, so none grows with the corpus.
    """
    level = counted.select("lang", "gram", F.col("n").cast("double").alias("c"))
    levels = [level]
    for n in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").cast("double").alias("c"))
        levels.append(level)
    probabilities, contexts, lower = [], [], None
    for n, level in enumerate(reversed(levels), 1):
        over = Window.partitionBy("lang", "__context")
        x = level.withColumn("__context", F.substring("gram", 1, n - 1) if n > 1 else F.lit(""))
        x = x.withColumn("__total", F.sum("c").over(over)).withColumn("__left", DISCOUNT * F.count("*").over(over) / F.col("__total"))
        if lower is None:
            x = x.withColumn("__lower", F.lit(1.0 / n_chars))
        else:
            x = x.withColumn("__suffix", F.substring("gram", 2, n - 1)).join(lower.select("lang", F.col("gram").alias("__suffix"), F.col("p").alias("__lower")), ["lang", "__suffix"])
        x = x.withColumn("p", (F.col("c") - DISCOUNT) / F.col("__total") + F.col("__left") * F.col("__lower"))
        lower = x.select("lang", "gram", "p")
        probabilities.append(x.select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("back")))
        contexts.append(x.groupBy("lang", F.col("__context").alias("gram")).agg(F.lit(None).cast("double").alias("logp"), F.log(F.min("__left")).alias("back")))
    rows = None
    for part in [*probabilities, *contexts]:
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("lang", "gram").agg(F.max("logp").alias("logp"), F.max("back").alias("back"))


@dataclass
class Arrays:
    """Sorted gram hashes of some languages; by hash and language the log probability (NaN: not seen) and the log weight left to shorter grams (0: not a context)."""

    keys: np.ndarray
    logp: np.ndarray
    back: np.ndarray
    floor: float

    @staticmethod
    def of(table: pa.Table, langs: list[str], floor: float) -> Arrays:
        grams = table.column("gram").to_pylist()
        by_length = np.array([len(g) for g in grams], np.int64)
        hashes = np.zeros(len(grams), np.uint64)
        for n in range(ORDER + 1):
            at = np.flatnonzero(by_length == n)
            hashes[at] = _hash(np.array([grams[i] for i in at], f"<U{max(1, n)}").view(np.uint32).reshape(len(at), -1)[:, :n])
        keys, row = np.unique(hashes, return_inverse=True)
        code = {x: i for i, x in enumerate(langs)}
        column = np.array([code[x] for x in table.column("lang").to_pylist()], np.int64)
        logp, back = np.full((len(keys), len(langs)), np.nan, np.float32), np.zeros((len(keys), len(langs)), np.float32)
        logp[row, column] = table.column("logp").to_numpy()
        back[row, column] = np.nan_to_num(table.column("back").to_numpy())
        return Arrays(keys, logp, back, floor)

    def _at(self, grams: np.ndarray) -> np.ndarray:
        """Place of each gram; -1: none."""
        h = _hash(grams)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character after the others, by language."""
        out = np.full((len(grams), self.logp.shape[1]), np.nan, np.float32)
        left = np.zeros_like(out)
        for n in range(ORDER, 0, -1):
            at = self._at(grams[:, ORDER - n :])
            found = np.where(at[:, None] >= 0, self.logp[at], np.nan)
            out = np.where(np.isnan(out), found + left, out)
            context = self._at(grams[:, ORDER - n : ORDER - 1])
            left += np.where(np.isnan(out) & (context[:, None] >= 0), self.back[context], 0)
        return np.where(np.isnan(out), left + np.float32(self.floor), out)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (nats) by text and language, and the number of letters."""
        chars, row = _chars(texts)
        at = _events(chars, row)
        grams, row_of = _grams(chars, row)[at], row[at]
        _, first, inverse = np.unique(_hash(grams), return_index=True, return_inverse=True)
        logs = self.scores(grams[first]).astype(np.float64) if len(first) else np.zeros((0, self.logp.shape[1]))
        total = np.stack([np.bincount(row_of, weights=logs[inverse, k], minlength=len(texts)) for k in range(logs.shape[1])], axis=1)
        n = np.bincount(row_of, minlength=len(texts))
        return -total / np.maximum(1, n)[:, None], np.bincount(row[chars != GAP], minlength=len(texts))


@dataclass
class Model:
    """grams: the table of `smoothed`, in the shared folder; groups: the languages scored in one pass each."""

    grams: DataFrame | None
    groups: list[list[str]] = field(default_factory=list)
    floor: float = 0.0
    temperature: float = 1.0
    reject_above: float = float("inf")

    @property
    def langs(self) -> list[str]:
        return sorted(x for g in self.groups for x in g)


def fit(rows: DataFrame, sample_rows: int = 4000, model_bytes: int = 64 << 20) -> Model:
    """rows (lang, text) -> the model.

    Rows without a language are left out; null and empty texts count nothing; repeated rows count
    each time; an empty table gives a model that knows no language.  At most a tenth of the
    rows, about `sample_rows`, chosen by text hash, are kept out of the counts and calibrate
    temperature and rejection; every other row is counted.  model_bytes bounds the arrays that
    are sent to the tasks for one pass (a language larger than that gets a pass of its own).
    """
    ship(rows.sparkSession)
    rows = rows.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n = rows.count()
    part = max(10, n // max(1, sample_rows))
    out = F.pmod(F.xxhash64(F.lit("calibration"), "text"), F.lit(part)) == 0
    counted = stored(counts(rows.where(~out)), "counts")
    n_chars = counted.agg(F.count_distinct(F.substring("gram", -1, 1))).first()[0]
    if not n_chars:
        return Model(None)
    grams = stored(smoothed(counted, n_chars), "grams")
    sizes = {r.lang: r.n for r in grams.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    groups: list[list[str]] = []
    size = 0
    for lang in sorted(sizes):
        # a dense cell per gram and language of the group, two float columns
        if groups and (size + sizes[lang]) * (len(groups[-1]) + 1) * 8 <= model_bytes:
            groups[-1].append(lang)
            size += sizes[lang]
        else:
            groups.append([lang])
            size = sizes[lang]
    model = Model(grams, groups, -float(np.log(n_chars)))
    # equal texts fall into the sample together; each is judged once
    sample = rows.where(out).where(F.col("lang").isin(model.langs)).distinct().orderBy(F.xxhash64("text"), "lang").limit(sample_rows)
    return calibrate(model, entropies(sample, model, "text", ["lang"]).select("lang", "entropy", "letters"))


def entropies(docs: DataFrame, model: Model, text: str, rest: list[str]) -> DataFrame:
    """docs -> the columns `rest`, entropy array<double> (in the order of model.langs), letters: one pass for each group of languages."""
    spark = docs.sparkSession
    out = docs.select(*rest, F.col(text).cast("string").alias("__text"), F.array().cast("array<double>").alias("entropy"), F.lit(0).cast("long").alias("letters"))
    for n, group in enumerate(model.groups):
        table = model.grams.where(F.col("lang").isin(group)).toArrow()
        sent = spark.sparkContext.broadcast(Arrays.of(table, group, model.floor))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                texts = whole.column("__text").to_pylist()
                for a, z in _parts(texts):
                    b = whole.slice(a, z - a)
                    entropy, letters = sent.value.entropies(texts[a:z])
                    more = [x + y for x, y in zip(b.column("entropy").to_pylist(), entropy.tolist(), strict=True)]
                    columns = {c: b.column(c) for c in b.schema.names} | {"entropy": pa.array(more, pa.list_(pa.float64())), "letters": pa.array(letters, pa.int64())}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        out = out.mapInArrow(run, out.schema)
        if n + 1 < len(model.groups):
            out = stored(out, "entropies")  # so that no task holds two groups' arrays
    return out.drop("__text")


def calibrate(model: Model, sample: DataFrame) -> Model:
    """Temperature by least negative log likelihood; rejection above the entropy that 999 of 1000 sample texts stay under, with a tenth to spare.

    What reaches the driver is a row of numbers for each sample text, no text.
    """
    rows = [r for r in sample.collect() if r.letters]
    if rows:
        entropy, letters = np.array([r.entropy for r in rows]), np.array([r.letters for r in rows])
        true = np.array([model.langs.index(r.lang) for r in rows])
        scaled = -(entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(letters)[:, None]
        grid = np.geomspace(0.05, 50, 40)
        loss = [np.mean(np.logaddexp.reduce(scaled * t, axis=1) - scaled[np.arange(len(true)), true] * t) for t in grid]
        # the least sharp of those that do as well, as a sample without errors would sharpen without end
        model.temperature = float(grid[int(np.flatnonzero(loss <= np.min(loss) + 1e-3)[0])])
        model.reject_above = float(np.quantile(entropy.min(axis=1), 0.999) * 1.1)
    return model


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> id, lang_pred, score, rejected; one row per row, from the whole text alone.

    `und` with score 0 for null texts and texts without a letter; ties go to the language that
    sorts first; repeated rows get equal results; without any training row all are `und`; an
    empty table gives an empty result; other columns are not read.  score is the posterior of
    the language; rejected: even the best language explains the text badly.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("__t"))
    if not model.groups:
        return own.select("id", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    e = entropies(own, model, "__t", ["id"])
    low = F.array_min("entropy")
    weights = F.transform("entropy", lambda x: F.exp(-(x - low) * F.sqrt(F.col("letters").cast("double")) * model.temperature))
    score = 1 / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*(F.lit(x) for x in model.langs)), F.array_position("entropy", low).cast("int"))
    some = F.col("letters") > 0
    return e.select(
        "id",
        F.when(some, best).otherwise(NONE).alias("lang_pred"),
        F.when(some, score).otherwise(0.0).alias("score"),
        (~some | (low > model.reject_above)).alias("rejected"),
    )
