"""Secret scanning with a random forest against false positives (DataFrame functions only).

Candidates are long runs of key characters, and shorter values with any signs where they are
assigned to a secret-like name.  A forest judges each by its length, character
transitions, dictionary coverage, path shape and neighbouring words.  The forest is trained
by Spark ML on a bounded set of labelled findings and then written as one SQL expression, so
scanning and redaction stay inside a row: nothing is shuffled and no text is cut.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

_NAME = r"(?i:token|secret|passwo?r?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|credential)[\"']?\s{0,2}(?::=|=>|[:=])\s{0,2}"
#: What is assigned to a secret-like name: in quotes any signs, else key characters or, where those are few, any signs.
#: Elsewhere key characters, with the padding of base64 where nothing follows it: `name=value` is two runs.
CANDIDATE = (
    rf"(?<=[\"'])(?<={_NAME}[\"'])[^\s\"'`]{{6,}}(?=[\"'])"
    r"|[A-Za-z0-9_+/.\-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=.\-\"']))?"
    rf"|(?<=[=:>\s])(?<={_NAME})[^\s\"'`,;<>()\[\]{{}}|]{{6,}}"
)
#: Characters of text before and after a candidate that its features see.
BEFORE, AFTER = 48, 16
MASK = "[SECRET]"
# Frequent words and word parts of the four languages, and what stands near secrets and near harmless hashes.
DICTIONARY = "the|and|tion|ing|ent|ion|ver|ich|und|der|die|sch|heit|keit|ung|eau|eux|que|ment|les|est|elle|cion|ado|os|de|er|en|re|an|on|at|ou|st|nd|th|in|es|le|el|al|ar|is|it|be|te|ti|to|or|ha|he|ea|ed|ly|wh|of|sh|nt"
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private.?key|client.?key)"
HARMLESS_WORDS = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|etag|revision|version|href|src|file|path|order|invoice|phone|card)"

HARD_WORDS = "required optional password secret string example changeme default because should between client request account number through language knowledge strength Rhythmus Geschwindigkeit Gesellschaft schifffahrt Wirtschaft Schlüssel jusqu quelque aujourd puisque trabajo ejemplo contraseña bibliothek system manager controller factory abstract handler session config public private".split()

FEATURES = ("n", "digits", "capitals", "small", "turns", "pairs", "known", "slashes", "dots", "signs", "prefixed", "assigned", "quoted", "secret_word", "harmless_word", "in_path")


def features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers that describe a candidate; shares are of its length."""
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda x: x.cast("double")
    return {
        "n": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "small": share("[a-z]"),
        # transitions between digits and letters, and between lower and upper case
        "turns": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"),
        # transitions from a consonant to a vowel and back, as in words
        "pairs": share("(?i)(?<=[bcdfghjklmnpqrstvwxz])[aeiouy]|(?<=[aeiouy])[bcdfghjklmnpqrstvwxz]"),
        "known": 1 - F.length(F.regexp_replace(F.lower(c), DICTIONARY, "")) / n,
        "slashes": share("/"),
        "dots": share(r"\."),
        "signs": share(r"[^\p{L}0-9_+/.\-]"),
        "prefixed": flag(c.rlike(r"^(AKIA|ASIA|ghp_|gho_|sk_|pk_|rk_|xox[abp]-|eyJ|AIza|glpat-)")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "secret_word": flag(before.rlike(SECRET_WORDS + r"[^\n]{0,12}$")),
        "harmless_word": flag(before.rlike(HARMLESS_WORDS + r"[^\n]{0,12}$")),
        "in_path": flag(before.rlike(r"(://\S*|[/\\])$") | c.rlike(r"^/|\.(py|js|html?|txt|md|java|png|jpg|pdf|com|org)\b")),
    }


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = 5) -> DataFrame:
    """A bounded set of labelled findings (candidate, before, after, label): random keys where keys
    stand, prefixed ones in plain prose too, and words, numbers, paths, hashes of commits and files where those stand."""
    r = random.Random(seed)
    syllables = [s for s in DICTIONARY.split("|") if len(s) > 1]
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    word = lambda least=1: "".join(r.choice(syllables) for _ in range(max(least, r.randint(1, 4))))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 8)))
    letters = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(n))
    signed = lambda n: "".join(r.sample([r.choice("!#$%&*?@^~"), r.choice("0123456789"), *(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789!#$%&*?@^~") for _ in range(n - 2))], n))
    names = ["token", "secret", "api_key", "apiKey", "password", "auth_token", "access_key", "client_secret", "Bearer", "private_key"]
    harmless = ["commit ", "sha1 ", "sha256: ", "md5 = ", "checksum: ", "etag: ", "revision ", "uuid ", "version "]

    def secret() -> tuple:
        key = r.choice([lambda: hexes(r.choice([32, 40, 40, 48, 64])), lambda: alnum(r.randint(20, 48)), lambda: "AKIA" + alnum(16).upper(), lambda: "ghp_" + alnum(36), lambda: "sk_live_" + alnum(24), lambda: alnum(30) + "/+" + alnum(8) + "==", lambda: letters(r.randint(16, 40)), lambda: "AKIA" + letters(16).upper(), lambda: signed(r.randint(8, 15)), lambda: word(2)[:8] + str(r.randint(0, 99)) + r.choice("!#$%&*?@") + letters(r.randint(2, 4)).lower()])()
        name, sign, quote = r.choice(names), r.choice([" = ", "=", ": ", ":", " := "]), r.choice(['"', "'", '"', ""])
        before, after = f"{prose()} {name}{sign}{quote}", f"{quote}{r.choice(['', ' ', '### ', '!! ', ' | '])}{prose()}"
        if r.random() < 0.1:
            key, before = key.upper(), before.upper()
        if r.random() < 0.25:
            # keys that tell their kind by a prefix stand in plain prose too
            prefix, n = r.choice([("AKIA", 16), ("ASIA", 16), ("ghp_", 36), ("gho_", 36), ("sk_live_", 24), ("AIza", 35), ("glpat-", 20), ("xoxb-", 24)])
            key = prefix + (alnum(n).upper() if prefix.endswith("SIA") or prefix == "AKIA" else alnum(n))
            before, after = prose() + r.choice([" ", " ", ": ", " (", "\n"]), r.choice([" ", ". ", ", ", ") ", "\n"]) + prose()
        return key, before[-BEFORE:], after[:AFTER], 1.0

    def other() -> tuple:
        kind = r.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 9])
        before, after = prose() + " ", r.choice([" ", ". ", ", "]) + prose()
        if kind <= 2:
            c = word(6)
            c = (c + word(4))[: r.randint(16, 40)].ljust(16, "e")
            c = c.capitalize() if r.random() < 0.3 else c.upper() if r.random() < 0.15 else c
            c += "." if r.random() < 0.3 else ""
            before += r.choice(["", "", "token ", "the secret ", '"'])
        elif kind == 3:
            c = "".join(r.choice("0123456789") for _ in range(r.randint(16, 20)))
        elif kind == 4:
            c, before = hexes(r.choice([32, 40, 64])), before + r.choice(harmless)
        elif kind == 5:
            h = hexes(32)
            c = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
            before += r.choice(["", "id ", "uuid ", "guid: "])
        elif kind == 6:
            c, before = "/".join(word() for _ in range(4)) + r.choice([".py", ".html", "/index.html", ".txt", ""]), before + r.choice(["", "/", "https://", "src/", "file "])
            c = c.ljust(16, "a")
        elif kind == 8:
            # words where a secret could stand, and names made of words
            joined = r.choice(["", "_", "-", "."]).join(r.choice(HARD_WORDS) for _ in range(r.randint(1, 4)))
            c = (joined if len(joined) >= 6 else joined + "ation") + r.choice(["", "", ".", "!"])
            sign, quote = r.choice([": ", " = ", "=", ":"]), r.choice(['"', "'", '"', ""])
            before, after = before + r.choice(names) + sign + quote, quote + after
        elif kind == 9:
            parts = [r.choice(HARD_WORDS) for _ in range(r.randint(3, 5))]
            c = r.choice(["".join(x.capitalize() for x in parts), "_".join(parts), "-".join(parts), "_".join(parts).upper(), "".join(parts), r.choice(["sk_", "pk_", "rk_", "gho_"]) + "_".join(parts)]).ljust(16, "e")
            before += r.choice(["", "token ", "the secret ", '"', "name = ", "type: "])
        else:
            c = f"{word()}.{r.randint(1, 99)}mail{r.randint(1, 9)}.example.com" if r.random() < 0.5 else ".".join(word() for _ in range(4)).ljust(16, "e")
        return c, before[-BEFORE:], after[:AFTER], 0.0

    made = [secret() if i % 2 else other() for i in range(rows)]
    return spark.createDataFrame(made, "candidate string, before string, after string, label double").coalesce(1)


def train(findings: DataFrame, trees: int = 25, depth: int = 6, seed: int = 5) -> str:
    """findings (candidate, before, after, label) -> SQL expression over columns named as FEATURES: the share of tree votes for `secret`."""
    f = features(F.col("candidate"), F.col("before"), F.col("after"))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(findings.select("label", *(f[k].alias(k) for k in FEATURES)))
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(table)

    def sql(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / sum(stats):.6f}D"
        split = node.split()
        return f"IF(f.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {sql(node.leftChild())}, {sql(node.rightChild())})"

    return "(" + " + ".join(sql(t._call_java("rootNode")) for t in model.trees) + f") / {trees}D"


def judged(text: Column, forest: str) -> Column:
    """Per candidate of a text: value, at (its number), score; and the text between the candidates."""
    t = F.coalesce(text, F.lit(""))
    found = F.struct(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split(t, CANDIDATE, -1).alias("between"))

    def scored(s: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.right(F.concat(F.coalesce(F.get(s["values"], i - 1), F.lit("")), F.get(s["between"], i)), F.lit(BEFORE))
            after = F.left(F.get(s["between"], i + 1), F.lit(AFTER))
            f = F.struct(*(v.alias(k) for k, v in features(c, before, after).items()))
            score = F.element_at(F.transform(F.array(f), lambda f: _with(forest, f)), 1)
            return F.struct(c.alias("value"), i.alias("at"), score.alias("score"))

        return F.struct(F.transform(s["values"], one).alias("found"), s["between"].alias("between"))

    return let(found, scored)


def _with(forest: str, f: Column) -> Column:
    """The forest as Column operations on the struct f."""

    def build(text: str, at: int) -> tuple[Column, int]:
        if text.startswith("IF(", at):
            name_end = text.index(" <= ", at)
            name = text[at + 5 : name_end]
            cut = text.index(",", name_end)
            threshold = float(text[name_end + 4 : cut - 1])
            left, at = build(text, cut + 2)
            right, at = build(text, at + 2)
            return F.when(f[name] <= threshold, left).otherwise(right), at + 1
        end = text.index("D", at)
        return F.lit(float(text[at:end])), end + 1

    body, trees = forest[1:].rsplit(") / ", 1)
    total, at = None, 0
    while at < len(body):
        tree, at = build(body, at)
        at += 3
        total = tree if total is None else total + tree
    return total / float(trees[:-1])


def scan(docs: DataFrame, forest: str, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """docs -> a row per secret: key, start (characters before it), n_chars, secret, score.

    Null and empty texts have none; repeated rows give their findings again; a secret that
    occurs twice in a text is found twice; an empty table has none.  Whole texts, however long, are
    scanned; other columns are not read.
    """
    d = docs.select(F.col(key).alias("__key"), judged(F.col(text), forest).alias("j"))
    kept = F.filter(F.col("j.found"), lambda x: x["score"] >= least)

    def placed(x: Column) -> Column:
        length = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, y: s + F.length(y))
        values = F.transform(F.slice(F.col("j.found"), F.lit(1), x["at"]), lambda y: y["value"])
        return F.struct((length(F.col("j.between"), x["at"] + 1) + F.aggregate(values, F.lit(0), lambda s, y: s + F.length(y))).alias("start"), x["value"].alias("value"), x["score"].alias("score"))

    d = d.where(F.size(kept) > 0).select("__key", F.explode(F.transform(kept, placed)).alias("x"))
    return d.select(F.col("__key").alias(key), F.col("x.start").cast("long").alias("start"), F.length("x.value").cast("long").alias("n_chars"), F.col("x.value").alias("secret"), F.col("x.score").alias("score"))


def redact(docs: DataFrame, forest: str, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with every secret of `text` replaced by MASK; all other columns and rows as they are (null texts stay null; an empty table stays empty)."""
    whole = let(
        judged(F.col(text), forest),
        lambda j: F.when(
            F.exists(j["found"], lambda x: x["score"] >= least),
            F.array_join(
                F.transform(j["between"], lambda b, i: F.concat(b, F.coalesce(F.when(F.get(j["found"], i)["score"] >= least, F.lit(MASK)).otherwise(F.get(j["found"], i)["value"]), F.lit("")))),
                "",
            ),
        ),
    )
    return docs.withColumn(text, F.coalesce(whole, F.col(text)))
