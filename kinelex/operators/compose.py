"""Codes of an item put together and in order: shared predicates and subjects, and a walk from the trunk outwards.

Rows are formatted codes: an item's key, side1, part1, intptt, side2, part2.  An item has at most
as many codes as the catalogue, so one item's codes may meet in one array; items never do.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import let, uniform

CODE = ("side1", "part1", "intptt", "side2", "part2")

# The parts that follow each part on the way from the trunk outwards.
FOLLOWING = {
    "body": ("head", "torso"),
    "torso": ("left_torso", "right_torso", "chest", "belly", "crotch", "upperback", "lowerback", "butt", "back", "{s}_shoulder", "{s}_arm", "{s}_hip", "{s}_leg"),
    "head": ("throat", "neck", "crown", "face"),
    "{s}_arm": ("{s}_upperarm", "{s}_forearm"),
    "{s}_upperarm": ("{s}_elbow", "{s}_shoulder"),
    "{s}_forearm": ("{s}_elbow", "{s}_hand"),
    "{s}_hand": ("{s}_wrist", "{s}_index"),
    "crotch": ("{s}_leg",),
    "{s}_leg": ("{s}_thigh", "{s}_shin", "{s}_lowerleg"),
    "{s}_thigh": ("{s}_hip", "{s}_knee"),
    "{s}_shin": ("{s}_knee", "{s}_foot"),
    "{s}_lowerleg": ("{s}_knee", "{s}_foot"),
    "{s}_foot": ("{s}_ankle", "{s}_toes"),
}


def edges() -> list[tuple[str, str]]:
    """Every step of the walk, both sides written out."""
    return list(dict.fromkeys((a.format(s=s), b.format(s=s)) for a, follow in FOLLOWING.items() for b in follow for s in ("left", "right")))


def paths() -> dict[str, list[list[int]]]:
    """For each part all ways to it from the body, as numbers of edges."""
    steps, found = edges(), {"body": [[]]}
    reached = [("body", [])]
    while reached:
        part, way = reached.pop()
        for i, (a, b) in enumerate(steps):
            if a == part:
                found.setdefault(b, []).append([*way, i])
                reached.append((b, [*way, i]))
    return found


def walk(key: Column, seed: int = 0) -> Column:
    """A map from part to a text whose order is that of a random depth-first walk of the parts, a walk of its own per key.

    Each edge draws eight hexadecimal digits.  A path's draws in a row sort as a walk that takes the
    lesser draw first would visit them, and a part that several paths reach is visited by the first.
    """
    ways = F.from_json(F.lit(json.dumps([{"part": p, "ways": w} for p, w in paths().items()])), "array<struct<part:string,ways:array<array<int>>>>")
    names = F.array(*(F.lit(f"{a}>{b}") for a, b in edges()))
    draws = F.transform(names, lambda e: F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("walk"), key.cast("string"), e)), 1, 8))
    visited = lambda d, w: F.array_min(F.transform(w, lambda way: F.array_join(F.transform(way, lambda i: F.get(d, i)), "")))
    return let(draws, lambda d: F.map_from_entries(F.transform(ways, lambda x: F.struct(x["part"], visited(d, x["ways"])))))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def fuse(rows: DataFrame, key: str = "pose_id", p: float = 1.0, seed: int = 0, exempt: Column | None = None) -> DataFrame:
    """Distinct codes -> key, how, grp, granted, codes: what is said together.

    Codes with the same predicate (category and second part) or the same subject (first part) can be
    said together.  Groups of at least two are looked at in drawn order; each takes those of its
    codes that no earlier group took, if two or more are left, so every code goes once.  A group that took
    codes is fused with probability p; codes of all others, and those that `exempt` names, stay alone
    (how: predicate, subject or alone).  A group's codes stand in drawn order.
    """
    r = rows.select(key, F.struct(*CODE).alias("code"), F.concat_ws("|", _text("side1"), "part1").alias("subject"), F.concat_ws("|", "intptt", _text("side2"), _text("part2")).alias("predicate"), (F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))).alias("off"))
    r = r.select("*", F.concat_ws("|", "subject", "predicate").alias("id")).dropDuplicates([key, "id"])
    sides = F.explode(F.array(*(F.struct(F.lit(how).alias("how"), F.col(how).alias("grp")) for how in ("predicate", "subject")))).alias("g")
    groups = r.where(~F.col("off")).select(key, "id", sides).groupBy(key, "g").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    drawn = groups.select(key, F.struct(uniform(seed, "fuse", F.col(key), F.col("g.how"), F.col("g.grp")).alias("draw"), F.col("g.how").alias("how"), F.col("g.grp").alias("grp"), "ids").alias("x"))
    none = F.from_json(F.lit('{"used":[],"taken":[]}'), "used array<string>, taken array<struct<how:string,grp:string,ids:array<string>>>")

    def take(state: Column, x: Column) -> Column:
        left = F.array_except(x["ids"], state["used"])
        more = F.struct(F.concat(state["used"], left).alias("used"), F.array_append(state["taken"], F.struct(x["how"].alias("how"), x["grp"].alias("grp"), left.alias("ids"))).alias("taken"))
        return F.when(F.size(left) > 1, more).otherwise(state)

    taken = drawn.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list("x")), none, take)["taken"].alias("taken")).select(key, F.explode("taken").alias("t"))
    granted = uniform(seed, "fused", F.col(key), F.col("t.how"), F.col("t.grp")) < p
    member = taken.select(key, "t.how", "t.grp", granted.alias("granted"), F.explode("t.ids").alias("id")).where("granted")
    said = r.join(member, [key, "id"], "left").select(key, "code", "id", F.coalesce("how", F.lit("alone")).alias("how"), F.coalesce("grp", "id").alias("grp"))
    order = F.struct(uniform(seed, "member", F.col(key), F.col("id")).alias("draw"), F.col("id"), F.col("code"))
    return said.groupBy(key, "how", "grp").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["code"]).alias("codes"))


def single(part: Column) -> Column:
    return F.when(part == "feet", "foot").when(part == "hands", "hand").otherwise(part)


def ordered(units: DataFrame, key: str = "pose_id", seed: int = 0) -> DataFrame:
    """units (key, grp, how, codes) plus place, from 0: in the order in which a walk of the key's own visits the first subject of each.

    What is said of both sides goes to a drawn side, or to the other if only that side is spoken of
    elsewhere.  Units of one part follow in drawn order; parts the walk doesn't know come last.
    """
    others = [c for c in units.columns if c != key]
    first = F.get("codes", F.lit(0))
    unit = F.struct(F.struct(*others).alias("unit"), first["side1"].alias("side"), first["part1"].alias("part"), uniform(seed, "unit", F.col(key), F.col("how"), F.col("grp")).alias("draw"))
    u = units.groupBy(key).agg(F.collect_list(unit).alias("units"))
    sided = F.filter("units", lambda x: x["side"].isin("left", "right"))
    u = u.withColumn("there", F.transform(sided, lambda x: F.concat_ws("_", x["side"], x["part"])))

    def spot(x: Column) -> Column:
        side = F.when(uniform(seed, "side", F.col(key), single(x["part"])) < 0.5, "left").otherwise("right")
        other = F.when(side == "left", "right").otherwise("left")
        on = lambda s: F.concat_ws("_", s, single(x["part"]))
        held = lambda s: F.array_contains("there", on(s))
        return F.when(x["side"] == "both", F.when(~held(side) & held(other), on(other)).otherwise(on(side))).otherwise(F.concat_ws("_", x["side"], x["part"]))

    def placed(visits: Column, x: Column) -> Column:
        return let(spot(x), lambda s: F.struct(F.coalesce(visits[s], F.lit("~")).alias("visit"), s.alias("spot"), x["draw"].alias("draw"), x["unit"]["how"], x["unit"]["grp"], x["unit"].alias("unit")))

    # the walk is met where it is made: exploded, it is hundreds of times what its key takes, which no estimate tells
    told = let(walk(F.col(key), seed), lambda visits: F.transform("units", lambda x: placed(visits, x)))
    out = u.select(key, F.posexplode(F.sort_array(told)).alias("place", "x"))
    return out.select(*(key if c == key else F.col(f"x.unit.`{c}`").alias(c) for c in units.columns), "x.spot", "place")
