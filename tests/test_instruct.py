"""Instructions against a plain reading of their rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from kinelex.operators import compose, pairs, realize, rewrite
from kinelex.plans import catalog, text_queries
from test_describe import drawn, key_of, noun_of, place_units, units_of

CHANGES = {realize.CHANGE + c for c in realize.PAIR_PHRASES}
ALONE_ONLY = {realize.CHANGE + c for c in (*catalog.PAIR_KINDS["pair_distance"].categories, "touch")}


def text_of(pair, codes, p):
    said_codes = {c for c in codes if c[2] in CHANGES or c[2] in realize.PHRASES}
    units = units_of(pair, [c for c in said_codes if c[2] not in ALONE_ONLY], p) + [("alone", key_of(c), [c]) for c in said_codes if c[2] in ALONE_ONLY]
    text, going = "", False
    ing = lambda v: v + "ting" if v == "let" else v.removesuffix("e") + "ing"
    for n, (how, grp, cs) in enumerate(place_units(pair, units)):
        step = "" if n == 0 else realize.STEPS[int(drawn("step", pair, n) * len(realize.STEPS))]
        going = step == ", while " if step != " and " else going
        many = how == "predicate" or cs[0][0] == "both" or cs[0][1] in ("hands", "feet", "toes")

        def said(c, subject, plural, i):
            d = drawn("phrase", pair, how, grp, i)
            other = noun_of(c[3], c[4]) if c[4] else "each other"
            if c[2].startswith(realize.CHANGE):
                bank = realize.PAIR_PHRASES[c[2].removeprefix(realize.CHANGE)]
                words = bank[int(d * len(bank))].replace("{s}", subject).replace("{o}", other).split(" ")
                return " ".join([ing(words[0]) if going else words[0], *words[1:]])
            silent = (c[4] == "torso" and c[2] in ("behind", "front")) or (c[4] == "shoulder" and c[1] in ("hand", "hands") and c[2] in ("at_right", "at_left")) or (c[4] == "hip" and c[1] in ("foot", "feet") and c[2] in ("at_right", "at_left")) or (c[4] == "neck" and c[1] in ("hand", "hands", "wrist") and c[2] == "above")
            bank = (realize.ALONE if (silent or c[4] is None) and c[2] in realize.ALONE else realize.PHRASES)[c[2]]
            ought = realize.OUGHT[int(drawn("ought", pair, how, grp, i) * len(realize.OUGHT))]
            ought = ought if plural else {"need to be": "needs to be", "end up": "ends up"}.get(ought, ought)
            return f"{'they' if subject == 'them' else subject} {ought} {bank[int(d * len(bank))].removeprefix('{s} {v} ').replace('{o}', other)}"

        names = [noun_of(*c[:2]) for c in cs]
        if how == "predicate":
            clause = said(cs[0], ", ".join(names[:-1]) + " and " + names[-1], True, 0)
        else:
            clause = said(cs[0], names[0], many, 0)
            for i, c in enumerate(cs[1:], 1):
                clause += realize.GOES_ON[int(drawn("link", pair, how, grp, i) * len(realize.GOES_ON))] + said(c, "them" if many else "it", many, i)
        text += step + clause
    return text


def polished(text):
    return ". ".join(s[:1].upper() + s[1:].lower() for s in " ".join(text.split()).split(". ")) + "."


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    p = text_queries.poses(spark, SF_DIR)
    changes = text_queries.stored(text_queries.pair_facts(spark, SF_DIR, text_queries.PAIR_ALL), "changes")
    facts = text_queries.stored(text_queries.codes.measure(p).select("pose_id", "code_id", "kind", "intptt_id"), "facts")
    path = str(tmp_path_factory.mktemp("rows") / "rows")
    realize.rewritten_changes(pairs.pairs_of(p), facts, changes, text_queries.contacts(spark, SF_DIR)).write.parquet(path)
    return spark.read.parquet(path)


def test_every_pair(spark, rows):
    by: dict[int, set] = {}
    for r in rows.collect():
        by.setdefault(r[0], set()).add(tuple(r)[1:])
    every = {c[2] for cs in by.values() for c in cs}
    assert {realize.CHANGE + "straighten", realize.CHANGE + "touch"} <= every and every & set(realize.PHRASES), "super-codes, contacts and facts about B are told"
    turned = {r["pair_id"]: r["degrees"] for r in text_queries.turns(spark, SF_DIR).collect()}
    bins = catalog.ROOT_ROTATION
    want = {}
    for pair in by.keys() | turned.keys():
        n = sum(turned[pair] > t for t in bins.thresholds) % len(bins.thresholds)
        lead = "" if "ignored" in bins.categories[n] else f"turn {bins.categories[n]}. "
        text = lead + text_of(pair, by.get(pair, set()), 0.95)
        if text:
            want[pair] = polished(text.removesuffix(". "))
    got = {r["pair_id"]: r["text"] for r in realize.instructions(rows, text_queries.turns(spark, SF_DIR)).collect()}
    assert got == want
    assert {r["pair_id"]: r["text"] for r in text_queries.instruct(spark, SF_DIR).collect()} == want


def test_new_contacts_only(spark, rows):
    told = {(r.pair_id, r.side1, r.part1, r.side2, r.part2) for r in rows.where(F.col("intptt") == realize.CHANGE + "touch").collect() if "both" not in (r.side1, r.side2)}
    c = {}
    for r in text_queries.contacts(spark, SF_DIR).collect():
        c.setdefault(r.pose_id, set()).add(tuple(r)[1:])
    assert told and all(tuple(x) in c[2 * pair + 1] - c.get(2 * pair, set()) for pair, *x in told)


def test_merging_of_parts(spark):
    """First parts, second parts, both; the larger change stays; other directions and sides don't meet."""
    rows = [
        (1, 1, "left", "hand", "c2", None, None, 5, 1, 2), (1, 2, "left", "elbow", "c1", None, None, 5, 1, 1), (1, 3, "right", "elbow", "c1", None, None, 5, 1, 1),
        (2, 1, "left", "hand", "c1", "right", "knee", 5, 1, 1), (2, 2, "left", "hand", "c1", "right", "ankle", 5, 1, 1), (3, 1, "left", "hand", "c1", "right", "knee", 5, 1, 1), (3, 2, "left", "elbow", "c3", "right", "ankle", 5, 1, 3),
        (4, 1, "left", "hand", "c1", None, None, 5, 1, 1), (4, 2, "left", "elbow", "c9", None, None, 5, -1, 1), (5, 1, None, "body", "z", None, None, 5, 0, 0), (5, 2, None, "torso", "y", None, None, 5, 0, 0),
    ]
    df = spark.createDataFrame(rows, "pair_id long, code_id int, side1 string, part1 string, intptt string, side2 string, part2 string, nature int, direction int, magnitude int")
    got = {tuple(r) for r in pairs.merge_entities(df, rewrite.ENTITIES).collect()}
    assert got == {
        (1, "left", "arm", "c2", None, None), (1, "right", "elbow", "c1", None, None), (2, "left", "hand", "c1", "right", "leg"), (3, "left", "arm", "c3", "right", "leg"),
        (4, "left", "hand", "c1", None, None), (4, "left", "elbow", "c9", None, None), (5, None, "body", "z", None, None), (5, None, "torso", "y", None, None),
    }
    poses = df.select(F.col("pair_id").alias("pose_id"), *compose.CODE)
    same = {tuple(r) for r in rewrite.merge_entities(poses.withColumn("intptt", F.lit("close"))).collect()}
    assert {(1, "left", "arm", "close", None, None), (2, "left", "hand", "close", "right", "leg"), (3, "left", "arm", "close", "right", "leg"), (4, "left", "arm", "close", None, None)} <= same


def test_forms_of_verbs(spark):
    verbs = [("move", "moves", "moving"), ("let", "lets", "letting"), ("stretch", "stretches", "stretching"), ("must", "must", "must"), ("end", "ends", "ending"), ("make", "makes", "making")]
    df = spark.createDataFrame([(v,) for v, _, _ in verbs], "v string")
    assert [tuple(r) for r in df.select("v", realize.third_person(F.col("v")), realize.gerund(F.col("v"))).collect()] == verbs
    first = {w.split(" ")[0] for ws in realize.PAIR_PHRASES.values() for w in ws}
    assert all(w.isalpha() for w in first) and realize.conjugated(F.lit("make {s} touch"), realize.gerund) is not None
