"""Descriptions against a plain reading of their rules: what is put together, its order, and the words."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from kinelex.operators import compose, realize, rewrite
from kinelex.plans import text_queries


def drawn(site, *keys, seed=0):
    return int(hashlib.md5("|".join([str(seed), site, *map(str, keys)]).encode()).hexdigest()[:8], 16) / 2**32


def key_of(code):
    return "|".join(x or "" for x in code)


def units_of(pose, codes, p):
    """Groups in drawn order take what is left to them."""
    codes = set(codes)
    groups = {}
    for c in codes:
        groups.setdefault(("predicate", key_of(c[2:])), []).append(c)
        groups.setdefault(("subject", key_of(c[:2])), []).append(c)
    used, units = set(), []
    for g in sorted((g for g in groups if len(groups[g]) > 1), key=lambda g: (drawn("fuse", pose, *g), g)):
        left = [c for c in groups[g] if c not in used]
        if len(left) > 1:
            used |= set(left)
            if drawn("fused", pose, *g) < p:
                units.append((*g, left))
    fused = {c for u in units for c in u[2]}
    units += [("alone", key_of(c), [c]) for c in codes - fused]
    return [(how, grp, sorted(cs, key=lambda c: (drawn("member", pose, key_of(c)), key_of(c)))) for how, grp, cs in units]


def visit_order(pose):
    """A depth-first walk that follows the lesser draw first."""
    follow = {}
    for a, b in compose.edges():
        follow.setdefault(a, []).append((hashlib.md5(f"0|walk|{pose}|{a}>{b}".encode()).hexdigest()[:8], b))
    seen = []

    def go(part):
        if part not in seen:
            seen.append(part)
        for _, b in sorted(follow.get(part, [])):
            go(b)

    go("body")
    return seen


def place_units(pose, units):
    seen = visit_order(pose)
    there = {f"{u[2][0][0]}_{u[2][0][1]}" for u in units if u[2][0][0] in ("left", "right")}

    def spot(u):
        side, part = u[2][0][:2]
        if side != "both":
            return f"{side}_{part}" if side else part
        part = {"feet": "foot", "hands": "hand"}.get(part, part)
        side, other = ("left", "right") if drawn("side", pose, part) < 0.5 else ("right", "left")
        return f"{other}_{part}" if f"{side}_{part}" not in there and f"{other}_{part}" in there else f"{side}_{part}"

    rank = lambda u: (seen.index(spot(u)) if spot(u) in seen else len(seen), spot(u), drawn("unit", pose, *u[:2]), *u[:2])
    return sorted(units, key=rank)


def noun_of(side, part):
    apart = {"upperarm": "upper arm", "lowerleg": "lower leg", "backdiag": "back"}
    if side == "both":
        part = {"foot": "feet", "feet": "feet", "hands": "hands", "toes": "toes"}.get(part, part + "s")
        return "both " + next((part.replace(a, b) for a, b in apart.items() if a in part), part)
    return ("the " + (side + " " if side else "")) + apart.get(part, part)


def text_of(pose, codes, p):
    units = place_units(pose, units_of(pose, [c for c in codes if c[2] in realize.PHRASES], p))
    text, state = "", False
    for n, (how, grp, cs) in enumerate(units):
        link = "" if n == 0 else realize.TRANSITIONS[int(drawn("transition", pose, n) * len(realize.TRANSITIONS))]
        state = (link == " with ") if link != " and " else state
        many = how == "predicate" or cs[0][0] == "both" or cs[0][1] in ("hands", "feet", "toes")
        verb, it = ("are", "they") if many else ("is", "it")

        def said(c, i):
            d = drawn("phrase", pose, how, grp, i)
            hand, foot = c[1] in ("hand", "hands"), c[1] in ("foot", "feet")
            silent = (c[4] == "torso" and c[2] in ("behind", "front")) or (c[4] == "shoulder" and hand and c[2] in ("at_right", "at_left")) or (c[4] == "hip" and foot and c[2] in ("at_right", "at_left")) or (c[4] == "neck" and (hand or c[1] == "wrist") and c[2] == "above")
            bank = realize.ALONE if (silent or c[4] is None) and c[2] in realize.ALONE else realize.PHRASES
            phrase = bank[c[2]][int(d * len(bank[c[2]]))]
            assert phrase.startswith("{s} {v} ")
            return phrase.removeprefix("{s} {v} ").replace("{o}", noun_of(c[3], c[4]) if c[4] else "each other")

        if how == "predicate":
            names = [noun_of(*c[:2]) for c in cs]
            clause = ", ".join(names[:-1]) + " and " + names[-1] + (" " if state else " are ") + said(cs[0], 0)
        else:
            clause = noun_of(*cs[0][:2]) + (" " if state else f" {verb} ") + said(cs[0], 0)
            for i, c in enumerate(cs[1:], 1):
                link_ = realize.LINKS[int(drawn("link", pose, how, grp, i) * (2 if state else len(realize.LINKS)))]
                clause += link_.replace("{v}", verb).replace("{it}", it) + said(c, i)
        text += link + clause
    return ". ".join(s[:1].upper() + s[1:].lower() for s in " ".join(text.split()).split(". ")) + "."


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """The codes of every pose after merging, some with contacts, stored."""
    r = rewrite.formatted(text_queries.settled(spark, SF_DIR)[1]).drop("code_id")
    r = rewrite.merge_contacts(r, rewrite.prune_contained(text_queries.contacts(spark, SF_DIR)))
    r = rewrite.collapse(rewrite.reverse(rewrite.merge_symmetric(rewrite.merge_entities(r))))
    path = str(tmp_path_factory.mktemp("rows") / "rows")
    r.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("p", [1.0, 0.6])
def test_every_pose(rows, p):
    by: dict[int, list] = {}
    for r in rows.select("pose_id", *compose.CODE).collect():
        by.setdefault(r[0], []).append(tuple(r)[1:])
    units = {}
    for r in compose.ordered(compose.fuse(rows, p=p)).orderBy("pose_id", "place").collect():
        units.setdefault(r["pose_id"], []).append((r["how"], r["grp"], [tuple(c) for c in r["codes"]]))
    assert units == {k: place_units(k, units_of(k, v, p)) for k, v in by.items()}
    assert all(sorted(map(key_of, {c for c in v})) == sorted(key_of(c) for u in units[k] for c in u[2]) for k, v in by.items()), "each code once"
    texts = {r["pose_id"]: r["text"] for r in realize.sentences(rows, "pose_id", p=p).collect()}
    assert texts == {k: text_of(k, v, p) for k, v in by.items()}


def test_both_limb_orders_occur_and_the_walk_meets_every_part(spark):
    walks = {r[0]: r[1] for r in spark.range(60).select("id", compose.walk(F.col("id"))).collect()}
    orders = {k: sorted(w, key=lambda p: w[p]) for k, w in walks.items()}
    assert all(o == visit_order(k) for k, o in orders.items()) and set(orders[0]) == {p for e in compose.edges() for p in e}
    assert len({o.index("left_arm") < o.index("left_leg") for o in orders.values()}) == 2 and len({o.index("left_arm") < o.index("right_arm") for o in orders.values()}) == 2


def test_whole_description_has_contacts_supers_and_no_blanks(spark):
    poses, touching = text_queries.poses(spark, SF_DIR), text_queries.contacts(spark, SF_DIR)
    texts = {r[0]: r[1] for r in realize.describe(poses, touching).collect()}
    assert len(texts) == poses.count() and not any(c in t for t in texts.values() for c in ("{", "}", "  ", "_", " ."))
    assert sum("touching" in t or "in contact" in t for t in texts.values()) > 20 and sum("in one line of sight" in t or "straight " in t for t in texts.values()) > 5
    plain = {r[0]: r[1] for r in realize.describe(poses, simple=True).collect()}
    assert len(plain) == len(texts) and plain != texts
