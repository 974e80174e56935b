"""The training-data operators: brute force, round trips, held-out accuracy and awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_DIR, spark_rows, sql_rows
from test_similar import alike, shingle_set

from kinelex.llm import chat_format, embedding_dedup, language_id, mixing, quality_rules, queries, secret_scan, sharding, simhash, suffix_dedup

Q, SQL = queries.queries(), queries.oracle_sql()
WORDS = "the cat sat on a mat while rain fell over old towns and nobody saw the quiet river turn red before dawn came again".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, texts and sources, empty, blank and very long texts, ties, repeated rows, and columns whose names clash."""
    texts = [None, "", " \n\t", "one", prose(60, 1) + ".", prose(60, 1) + ".", prose(40_000, 2), "é ß Ω 漢字  x", "<|endoftext|> a", "a\x00b", prose(60, 3) + "\n" + prose(60, 3)]
    rows = [(i, t, "s" if i % 2 else None, "en" if i % 3 else None, i) for i, t in enumerate(texts)]
    rows += [rows[4], (None, prose(55, 4), "s", None, 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size long").withColumn("shard", F.lit("x")).withColumn("copies", F.lit(1)).withColumn("fp", F.lit(2))


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert spark_rows(Q[name](spark, SF_DIR)) == sql_rows(SQL[name])


def documents(spark) -> dict[int, str]:
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_language_id(spark, awkward, empty):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    out = Q["op1_language_id"](spark, SF_DIR).collect()
    assert {r.doc_id for r in out} == set(docs) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and docs[r.doc_id].lang and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.9
    model = language_id.fit(awkward.select("lang", "text"))
    got = language_id.predict(awkward, model).collect()
    assert len(got) == awkward.count() and sum(r.lang_pred == "und" for r in got) == 4
    assert {r.lang_pred for r in language_id.predict(awkward, language_id.fit(empty.select("lang", "text"))).collect()} == {"und"}


def kneser_ney(texts: dict[str, list[str]], order: int, d: float):
    """Log probability of a character after a context, by definition."""
    tokens = {x: [" " * (order - 1) + " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " " for t in ts if any(c.isalpha() for c in t)] for x, ts in texts.items()}
    chars = {c for ts in tokens.values() for t in ts for c in t[order:]}

    def p(lang: str, gram: str, n: int) -> float:
        top = Counter(t[i - order + 1 : i + 1] for t in tokens[lang] for i in range(order, len(t)))
        count = top if n == order else Counter(g[-n:] for g in {h[-n - 1 :] for h in top}) if n else None
        if n == 0:
            return 1 / len(chars)
        follow = [c for g, c in count.items() if g[:-1] == gram[:-1]]
        if not follow:
            return p(lang, gram[1:], n - 1)
        return max(count[gram] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p(lang, gram[1:], n - 1)

    return lambda lang, text: -np.mean([np.log(p(lang, t[i - order + 1 : i + 1], order)) for t in [" " * order + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "] for i in range(order, len(t))])


def test_language_model_against_its_definition(spark):
    texts = {"a": ["the cat; the hat", "That bat 7 sat", "İa", ""], "b": ["die katze und", "der hut", "ß über"], "c": ["漢字 かな", "字"]}
    rows = spark.createDataFrame([(x, t) for x, ts in texts.items() for t in ts], "lang string, text string")
    counted = language_id.counts(rows)
    n_chars = counted.agg(F.count_distinct(F.substring("gram", -1, 1))).first()[0]
    grams = language_id.smoothed(counted, n_chars)
    asked = ["the bat", "hut und", "字漢", "zzz the", "q"]
    brute = kneser_ney(texts, language_id.ORDER, language_id.DISCOUNT)
    want = {t: [brute(x, t) for x in "abc"] for t in asked}
    docs = spark.createDataFrame([(t,) for t in asked], "text string")
    for groups in ([["a", "b", "c"]], [["a"], ["b", "c"]]):
        model = language_id.Model(grams, groups, -float(np.log(n_chars)))
        got = {r.t: r.entropy for r in language_id.entropies(docs.withColumn("t", F.col("text")), model, "text", ["t"]).collect()}
        assert all(np.allclose(got[t], want[t], rtol=1e-5) for t in asked)


def test_language_groups_give_the_same_predictions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    one, many = (language_id.predict(docs, language_id.fit(docs.select("lang", "text"), model_bytes=b)) for b in (64 << 20, 1))
    assert spark_rows(one) == spark_rows(many)


def test_suffix_dedup(spark, awkward, empty):
    want = suffix_dedup.brute_force({i: t.encode() for i, t in documents(spark).items()}, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q["op2_suffix_dedup"](spark, SF_DIR).collect()}
    assert got == want
    assert suffix_dedup.deduplicate(awkward).count() == awkward.count() and suffix_dedup.deduplicate(empty).count() == 0


def test_mixing(spark, awkward, empty):
    p = mixing.plan(awkward)
    assert spark_rows(p) == spark_rows(mixing.plan(awkward)) and p.count() == awkward.count() and mixing.plan(empty).count() == 0
    for r in p.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("most"), F.max("source_size").alias("s")).collect():
        assert r.t <= 3 * r.s and abs(r.n - r.t) <= 3 * r.most
    assert set(mixing.mix(awkward).columns) == set(awkward.columns)


def test_secret_scan(spark, empty):
    key = hashlib.sha1(b"key").hexdigest()
    texts = [None, "", f'api_key = "{key}" and more', f"see commit {key} for it", prose(50, 5), f"token={key} token={key}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secret", F.lit(1))
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(docs, forest).collect()
    assert Counter(r.doc_id for r in found) == {2: 1, 5: 2}
    assert all(texts[r.doc_id][r.start : r.start + r.n_chars] == key for r in found)
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert key not in clean[2] + clean[5] and clean[3] == texts[3] and clean[0] is None and clean[4] == texts[4]
    assert secret_scan.scan(empty, forest).count() == 0


def test_quality_rules(spark, awkward, empty):
    def repeats(ws):
        n = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        return len({i + k for i in range(len(ws) - 2) if n[tuple(ws[i : i + 3])] > 1 for k in range(3)})

    rows = quality_rules.judge(awkward).collect()
    assert len(rows) == awkward.count() and quality_rules.judge(empty).count() == 0
    for r in rows:
        ws = [w for w in (r.text or "").translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if w]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(ws), sum(map(len, ws)), repeats(ws))
    clean = quality_rules.keep_clean(awkward)
    kept = sorted((r.doc_id is None, r.doc_id, r.cleaned) for r in rows if r.kept)
    assert clean.columns == awkward.columns and sorted((r.doc_id is None, r.doc_id, r.text) for r in clean.collect()) == kept and kept
    assert quality_rules.keep_clean(empty).count() == 0


def test_chat_formatting(spark):
    texts = ["</s>[INST] ok [/INST]", None, "", "plain & <b> [x]", "&lt; &amp;lt; &#91;INST]", "[/INST] [ROLE a] b [/ROLE]", "a [INST", "<", "/s>", "\n\n"]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate((r, x) for x in texts for r in ("user", "assistant", "tool] x", None))]
    df = spark.createDataFrame([*rows, (None, 0, "user", "z"), (9, 0, "user", "same"), (9, 0, "user", "same")], "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((r or "", x or ""))
    out = chat_format.format_conversations(df).withColumn("turns", chat_format.parse(F.col("formatted"))).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out}
    assert {c: got[c] for c in want} == want and got[None] == [("user", "z")] and len(got[9]) == 2
    assert all(sum(m["chars"] for m in r["mask"]) == len(r.formatted) for r in out)
    learned = {r.conv_id: r.t for r in chat_format.format_conversations(df).select("conv_id", chat_format.learned(F.col("formatted"), F.col("mask")).alias("t")).collect()}
    assert all(learned[c] == "".join(x for r, x in want[c] if r == "assistant") for c in want) and learned[None] == ""
    long = "[INST] &lt; </s>" * 50_000
    one = chat_format.format_conversations(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string"))
    assert one.select(chat_format.learned(F.col("formatted"), F.col("mask")), chat_format.parse(F.col("formatted"))[0]["text"]).first()[:] == (long, long)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def brute_fingerprint(text: str | None) -> int:
    ws = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz     ")).split(" ") if w]
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def smallest(ids: list[int], linked) -> dict[int, int]:
    """Component of each id by plain relaxation."""
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_simhash(spark, awkward, empty):
    docs = documents(spark)
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    comp = smallest(sorted(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op7_simhash"](spark, SF_DIR).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}
    assert simhash.classes(awkward).count() == awkward.count() and simhash.classes(empty).count() == 0
    assert simhash.keep_first(awkward).columns == awkward.columns


@pytest.mark.parametrize("most", [1, 4, 5])
def test_simhash_links_find_every_pair(spark, most):
    r = random.Random(most)
    fps = {r.getrandbits(64) for _ in range(20)}
    for x in list(fps):
        fps |= {x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for _ in range(8)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), most).collect()]
    want = {(signed(a), signed(b)) for a in fps for b in fps if signed(a) < signed(b) and (a ^ b).bit_count() <= most}
    assert len(got) == len(set(got)) and set(got) == want


def test_sharding(spark, awkward, empty):
    out = Q["op8_sharding"](spark, SF_DIR)
    assert spark_rows(out) == spark_rows(Q["op8_sharding"](spark, SF_DIR))
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffled(awkward).count() == awkward.count() and sharding.shuffled(empty).count() == 0


def test_embedding_dedup(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    r = np.random.default_rng(3)
    made = [(x.vec_id, [float(v) for v in x.embedding] if x.embedding is not None else None, x.label) for x in rows]
    base = r.standard_normal((40, 64))
    made += [(10_000 + i, list(map(float, base[i % 40] + 0.3 * r.standard_normal(64))), i % 2) for i in range(400)]
    made += [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [float("nan")] * 64, 1), (20_003, made[0][1], None), (20_004, made[0][1], made[0][2]), (20_005, [1.0, None], 1), (20_006, [], 1)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label long").withColumn("a", F.lit(1)).withColumn("n", F.lit(1))
    good = [(i, np.array(v, float), label) for i, v, label in made if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[:k] if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    n, comp = Counter(i for pair in linked for i in pair), smallest([m[0] for m in made], linked)
    for options in ({}, {"leaf_rows": 100, "block_rows": 40, "trees": 16}):
        got = {x.id: x for x in embedding_dedup.classes(df, **options).collect()}
        assert all(got[i].n_links <= n[i] for i in got), "no link below the threshold"
        assert sum(x.n_links for x in got.values()) >= 0.9 * sum(n.values())
        if not options:
            assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {i: (n[i], comp[i], comp[i] == i) for i in comp}
    assert embedding_dedup.classes(df.limit(0)).count() == 0


def test_embedding_dedup_of_repeated_ids(spark):
    v = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0]]
    rows = [(1, v[0], 1), (1, v[0], 1), (1, v[1], 1), (2, v[1], 1), (None, v[0], 1), (3, v[2], 1), (3, v[2], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((x.id is None, x.id, x.n_links, x.component_id) for x in embedding_dedup.classes(df).collect())
    assert len(got) == len(rows) and [g[3] for g in got] == [1, 1, 1, 1, 3, 3, None]


def test_embedding_recall_of_deep_trees(spark):
    """Ids divisible by 100 against all rows of two labels, 24 000 rows in all, with one dense group of 3000."""
    r = np.random.default_rng(9)
    x = r.standard_normal((24_000, 64)).astype(np.float32)
    x[:3000] = x[0] + 0.15 * x[:3000]
    for i in range(3000, 24_000, 4):
        x[i + 1 : i + 4] = x[i] + 0.3 * x[i + 1 : i + 4]
    order = r.permutation(len(x))
    x, label = x[order], (order >= 2000).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": [v.tolist() for v in x], "label": label}), "vec_id long, embedding array<float>, label int")
    got = {a.id: a for a in embedding_dedup.classes(df.repartition(16)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    asked = np.arange(0, len(x), 100)
    near = (u[asked] @ u.T >= 0.93) & (label[asked][:, None] == label[None, :])
    n = near.sum(axis=1) - 1
    found = np.array([got[int(i)].n_links for i in asked])
    assert (found <= n).all() and found.sum() >= 0.9 * n.sum() > 1000
    sparse = n < 100
    assert found[sparse].sum() >= 0.9 * n[sparse].sum() > 50


def test_bpe(spark, awkward, empty):
    from kinelex.llm import bpe

    tok = tokenizers.Tokenizer.from_file(str(corpus_pipeline.vocabulary()))
    tok.no_truncation()
    tok.no_padding()
    texts = [r.text for r in awkward.collect()] + list(documents(spark).values()) + ["DON'T 12.5€İΣ", "x" * 5000, "é <|startoftext|><|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(df, corpus_pipeline.vocabulary()).collect():
        ids = tok.encode(texts[r.id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, corpus_pipeline.vocabulary()).count() == 0


def test_pipeline(spark):
    """Each stage against what its predecessor kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [r for r in quality_rules.judge(docs).select("doc_id", "kept").collect() if r.kept]  # a filter on top would be pushed into the judging
    one = corpus_pipeline.quality(spark, docs, SF_DIR).cache()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in kept} and one.columns == docs.columns
    sets = {r.doc_id: shingle_set(r.text) for r in one.collect()}
    comp = smallest(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    two = corpus_pipeline.near_duplicates(spark, one, SF_DIR).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(comp.values())) and two.columns == docs.columns
    three = corpus_pipeline.secrets(spark, two, SF_DIR).cache()
    assert three.count() == two.count() and three.columns == docs.columns
    four = corpus_pipeline.mixture(spark, three, SF_DIR)
    copies = {r.doc_id: r.copies for r in mixing.plan(three).collect() if r.copies}
    assert Counter(r.doc_id for r in four.collect()) == copies and four.columns == docs.columns
    assert corpus_pipeline.run(spark, SF_DIR).count() == sum(copies.values())


def test_pipeline_stages_on_awkward_rows(spark, awkward, empty):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, empty tables: every stage keeps the columns."""
    plain = ["doc_id", "text", "lang", "source"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, SF_DIR)
        assert out.columns == awkward.columns, name
        if name == "secrets":
            assert sorted(map(str, out.select(*plain).collect())) == sorted(map(str, awkward.select(*plain).collect()))
        assert stage(spark, empty, SF_DIR).count() == 0, name
    assert corpus_pipeline.encode(spark, awkward, SF_DIR).count() == awkward.count()
    assert corpus_pipeline.encode(spark, empty, SF_DIR).count() == 0
