"""Rewriting of a pose's codes: pruning, merging, fusing, ordering.

Rows are formatted codes: pose_id, code_id, side1, part1, intptt, side2, part2.  All rules are
set operations with a fixed order, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import uniform
from ..plans import catalog
from ..plans.catalog import CODES, KINDS, split_side
from .compose import CODE
from .pairs import ORDER

#: Kinds whose codes talk about their focus part alone.
FOCUS_KINDS = ("angle", "relativeVAxis", "onGround", "bodyInclineX", "bodyInclineY", "bodyInclineZ", "relativeRotX", "relativeRotY", "relativeRotZ")

# Two parts that make one.
ENTITIES = (
    ("wrist", "elbow", "arm"),
    ("hand", "elbow", "arm"),
    ("ankle", "knee", "leg"),
    ("foot", "knee", "leg"),
    ("forearm", "upperarm", "arm"),
    ("shin", "thigh", "leg"),
    ("lowerleg", "thigh", "leg"),
    ("upperback", "lowerback", "back"),
    ("belly", "chest", "torso"),
    ("index", "wrist", "hand"),
    ("toes", "ankle", "foot"),
)
# Which body part contains which.
CONTAINS = {
    "hand": ("index", "wrist"),
    "forearm": ("hand", "wrist", "elbow"),
    "upperarm": ("elbow", "shoulder"),
    "arm": ("forearm", "upperarm", "shoulder"),
    "foot": ("toes", "ankle"),
    "lowerleg": ("foot", "ankle", "knee"),
    "thigh": ("knee", "hip"),
    "leg": ("lowerleg", "thigh", "hip"),
    "torso": ("hip", "shoulder", "back", "chest", "belly", "crotch"),
    "back": ("upperback", "lowerback", "butt"),
    "neck": ("throat",),
    "head": ("face", "crown"),
}


def format_rows() -> list[tuple]:
    """code_id, intptt_id, kind, side1, part1, intptt, side2, part2 of codes and, numbered after them, of super-codes."""
    rows = []
    for i, c in enumerate(CODES):
        first = c.focus or c.joints[0]
        second = None if c.kind in FOCUS_KINDS else next(j for j in (c.joints[1], c.joints[0]) if j != first)
        for n, name in enumerate(KINDS[c.kind].categories):
            rows.append((i, catalog.OFFSET[c.kind] + n, c.kind, *split_side(first), name, *split_side(second)))
    for i, s in enumerate(catalog.SUPERS):
        rows.append((len(CODES) + i, catalog.CATEGORIES.index(s.category), "super", *split_side(s.focus[0]), s.category, *split_side(s.focus[1] if len(s.focus) > 1 else None)))
    return rows


def format_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(format_rows(), "code_id int, intptt_id int, kind string, side1 string, part1 string, intptt string, side2 string, part2 string")


def formatted(eligible: DataFrame) -> DataFrame:
    """Eligible facts as formatted codes."""
    t = F.broadcast(format_table(eligible.sparkSession))
    return eligible.where("elig > 0").join(t.drop("kind"), ["code_id", "intptt_id"]).select("pose_id", "code_id", "side1", "part1", "intptt", "side2", "part2")


#: Categories that order two parts along an axis, and whether the first part is the lesser.
ORDERINGS = {"below": ("y", 1), "above": ("y", 0), "behind": ("z", 1), "front": ("z", 0), "at_right": ("x", 1), "at_left": ("x", 0)}


def prune_transitive(rows: DataFrame) -> DataFrame:
    """Drops a < c where a < b and b < c are there, whichever way each is put."""
    spark = rows.sparkSession
    t = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in ORDERINGS.items()], "intptt string, axis string, first_less int"))
    name = lambda n: F.concat_ws("_", f"side{n}", f"part{n}")
    e = rows.where("part2 is not null").join(t, "intptt").select("pose_id", "code_id", "axis", F.when(F.col("first_less") == 1, name(1)).otherwise(name(2)).alias("lo"), F.when(F.col("first_less") == 1, name(2)).otherwise(name(1)).alias("hi"))
    ab, bc = (e.select("pose_id", "axis", "lo", "hi").alias(x) for x in ("ab", "bc"))
    outer = ab.join(bc, (F.col("ab.pose_id") == F.col("bc.pose_id")) & (F.col("ab.axis") == F.col("bc.axis")) & (F.col("ab.hi") == F.col("bc.lo"))).select("ab.pose_id", "ab.axis", "ab.lo", "bc.hi").distinct()
    dropped = e.join(outer, ["pose_id", "axis", "lo", "hi"]).select("pose_id", "code_id")
    return rows.join(dropped, ["pose_id", "code_id"], "left_anti")


def merge_entities(rows: DataFrame, p: float = 1.0, seed: int = 0, key: str = "pose_id") -> DataFrame:
    """Two codes of one category become one where parts of theirs make a larger part.

    The sides of first and second parts must be the same in both.  Either the first parts make one and
    the second parts are equal, or the other way round, or both make one.  Every such pair of codes is
    replaced, with probability p, by the code of the larger parts; what came of it is distinct, the rest stays.
    """
    spark = rows.sparkSession
    t = F.broadcast(spark.createDataFrame([*ENTITIES, *((y, x, e) for x, y, e in ENTITIES)], "x string, y string, entity string"))
    r = rows.select(key, *CODE).distinct()
    a = r.select(key, *(F.col(c).alias(f"{c}_a") for c in CODE))
    same = F.col("intptt_a") == F.col("intptt")
    for c in ("side1", "side2"):
        same = same & F.col(f"{c}_a").eqNullSafe(F.col(c))
    both = a.join(r, key).where(same)
    for i, n in enumerate(("part1", "part2")):
        both = both.join(t.select(F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("entity").alias(f"e{i}")), (F.col(f"{n}_a") == F.col(f"x{i}")) & (F.col(n) == F.col(f"y{i}")), "left")
    alike = [F.col(f"{n}_a").eqNullSafe(F.col(n)) for n in ("part1", "part2")]
    made = (F.col("e0").isNotNull() & (alike[1] | F.col("e1").isNotNull())) | (F.col("e1").isNotNull() & alike[0])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    once = F.struct(text("part1_a"), text("part2_a")) < F.struct(text("part1"), text("part2"))
    drawn = uniform(seed, "entity", F.col(key), text("side1"), text("part1_a"), text("part1"), F.col("intptt"), text("side2"), text("part2_a"), text("part2")) < p
    both = both.where(made & once & drawn)
    merged = both.select(key, "side1", F.coalesce("e0", "part1").alias("part1"), "intptt", "side2", F.coalesce("e1", "part2").alias("part2"))
    gone = both.select(key, "side1", F.col("part1_a").alias("part1"), "intptt", "side2", F.col("part2_a").alias("part2")).unionByName(both.select(key, *CODE)).distinct()
    names = [f"gone_{c}" for c in CODE]
    gone = gone.select(F.col(key).alias("gone_key"), *(F.col(c).alias(n) for c, n in zip(CODE, names, strict=True)))
    on = F.col(key) == F.col("gone_key")
    for c, n in zip(CODE, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return r.join(gone, on, "left_anti").unionByName(merged).distinct()


def merge_symmetric(rows: DataFrame) -> DataFrame:
    """Left and right that say the same become one code of both; the second part becomes both only if its sides differ."""
    g = rows.where("side1 in ('left', 'right')").groupBy("pose_id", "part1", "intptt", "part2").agg(F.count_distinct("side1").alias("sides"), F.count_distinct("side2").alias("sides2"), F.min("side2").alias("one2"))
    g = g.where("sides = 2")
    merged = g.select("pose_id", F.lit("both").alias("side1"), "part1", "intptt", F.when(F.col("sides2") > 1, "both").otherwise(F.col("one2")).alias("side2"), "part2")
    key = g.select(F.col("pose_id").alias("p"), F.col("part1").alias("x"), F.col("intptt").alias("i"), F.col("part2").alias("y"))
    on = (F.col("pose_id") == F.col("p")) & (F.col("part1") == F.col("x")) & (F.col("intptt") == F.col("i")) & F.col("part2").eqNullSafe(F.col("y")) & F.col("side1").isin("left", "right")
    rest = rows.join(key, on, "left_anti").select("pose_id", "side1", "part1", "intptt", "side2", "part2")
    return rest.unionByName(merged)


def _named(kind: str, one: str, two: str | None, category: str) -> tuple[str, tuple[str, ...], str]:
    joints = next(c.joints for c in CODES if c.kind == kind and c.joints[0] == one and (two is None or c.joints[1] == two))
    return kind, joints, category


def stat_rules() -> list[tuple[tuple, tuple | None, tuple]]:
    """(code, code or None, implied code), each mirrored.  Codes are (kind, joints, category)."""
    y, z = "relativePosY", "relativePosZ"
    hand_high = _named(y, "left_hand", "left_shoulder", "above")
    r_hand_high = _named(y, "right_hand", "right_shoulder", "above")
    hand_neck, r_hand_neck = _named(y, "left_wrist", "neck", "above"), _named(y, "right_wrist", "neck", "above")
    hand_low, r_hand_low = _named(y, "left_hand", "left_hip", "below"), _named(y, "right_hand", "right_hip", "below")
    pair = lambda kind, part, c: _named(kind, f"left_{part}", f"right_{part}", c)
    axis = lambda one, c: _named("relativeVAxis", one, None, c)
    foot = lambda s, c: _named(z, f"{s}_foot", "torso", c)
    hand = lambda s, c: _named(z, f"{s}_hand", "torso", c)
    bend = lambda part, c: _named("angle", part, None, c)
    thigh, shin, upperarm, r_upperarm, forearm = "left_hip", "left_knee", "left_shoulder", "right_shoulder", "left_elbow"
    near = lambda part: pair("distance", part, "close")
    # What implies what, in the order of the rules.
    rules = [
        (hand_neck, None, hand_high),
        (bend("left_hip", "right angle"), axis(thigh, "vertical"), foot("left", "behind")),
        (pair(z, "foot", "behind"), foot("left", "front"), foot("right", "front")),
        (pair(z, "foot", "front"), foot("left", "behind"), foot("right", "behind")),
        (hand_high, r_hand_low, pair("distance", "hand", "wide")),
        (hand_high, r_hand_low, pair(y, "shoulder", "above")),
        (hand_high, r_hand_low, pair(y, "elbow", "above")),
        (hand_high, r_hand_low, pair(y, "hand", "above")),
        (hand_low, axis(r_upperarm, "horizontal"), pair(y, "elbow", "below")),
        (hand_low, axis(r_upperarm, "horizontal"), pair(y, "hand", "below")),
        (near("hand"), hand_high, r_hand_high),
        (near("hand"), hand_neck, r_hand_high),
        (near("hand"), hand_neck, r_hand_neck),
        (near("hand"), hand_low, r_hand_low),
        (near("foot"), foot("left", "behind"), foot("right", "behind")),
        (pair(y, "elbow", "above"), hand_low, r_hand_low),
        (pair(y, "hand", "below"), hand_high, r_hand_high),
        (pair(y, "hand", "below"), hand_high, r_hand_neck),
        (hand_neck, r_hand_low, pair("distance", "hand", "wide")),
        (pair(y, "hand", "above"), hand_low, r_hand_low),
        (hand_neck, r_hand_low, pair(y, "elbow", "above")),
        (hand_neck, r_hand_low, pair(y, "hand", "above")),
        (pair(z, "hand", "front"), hand("left", "behind"), hand("right", "behind")),
        (axis(upperarm, "vertical"), axis(forearm, "horizontal"), bend("left_shoulder", "right angle")),
        (axis(thigh, "vertical"), axis(shin, "vertical"), bend("left_hip", "straight")),
        (pair(z, "knee", "behind"), axis(thigh, "horizontal"), foot("left", "behind")),
        (pair(z, "knee", "front"), axis(thigh, "vertical"), foot("right", "behind")),
    ]
    return [r for rule in rules for r in (rule, tuple(mirrored_code(c) for c in rule))]


def mirrored_code(code: tuple | None) -> tuple | None:
    """Sides exchanged; a code between left and right of one part takes the opposite category instead."""
    if code is None:
        return None
    kind, joints, category = code
    swap = {"left": "right", "right": "left"}
    other = tuple(f"{swap[s]}_{p}" if (s := j.partition("_")[0]) in swap and (p := j.partition("_")[2]) else j for j in joints)
    if (kind, other) in catalog.CODE_ID:
        return kind, other, category
    return kind, joints, catalog.OPPOSITES.get(category, category)


def rule_rows() -> list[tuple]:
    """rule, code_a, cat_a, code_b, cat_b (-1: none), code_c, cat_c."""
    ids = lambda c: (-1, -1) if c is None else (catalog.CODE_ID[c[0], c[1]], catalog.OFFSET[c[0]] + KINDS[c[0]].categories.index(c[2]))
    return [(i, *ids(a), *ids(b), *ids(c)) for i, (a, b, c) in enumerate(stat_rules())]


def prune_statistical(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """rows and raw (pose_id, code_id, intptt_id): drops from rows what a rule says that holds on raw."""
    spark = rows.sparkSession
    rules = F.broadcast(spark.createDataFrame(rule_rows(), "rule int, ca int, ia int, cb int, ib int, cc int, ic int"))
    a = raw.join(rules, (F.col("code_id") == F.col("ca")) & (F.col("intptt_id") == F.col("ia"))).select("pose_id", "rule", "cb", "ib", "cc", "ic")
    b = raw.select(F.col("pose_id").alias("pb"), F.col("code_id").alias("cb2"), F.col("intptt_id").alias("ib2"))
    held = a.where("cb >= 0").join(b, (F.col("pose_id") == F.col("pb")) & (F.col("cb") == F.col("cb2")) & (F.col("ib") == F.col("ib2"))).select("pose_id", "cc", "ic").union(a.where("cb < 0").select("pose_id", "cc", "ic"))
    gone = held.distinct().select("pose_id", F.col("cc").alias("code_id"), F.col("ic").alias("intptt_id"))
    return rows.join(gone, ["pose_id", "code_id", "intptt_id"], "left_anti")


def reverse(rows: DataFrame, p: float = 0.5, seed: int = 0) -> DataFrame:
    """With probability p the sides of a code between left and right of one part change places; a category of order becomes its opposite."""
    swap = F.create_map(*(F.lit(x) for kv in catalog.OPPOSITES.items() for x in kv))
    turn = (F.col("part1") == F.col("part2")) & ~F.col("side1").eqNullSafe(F.col("side2")) & (uniform(seed, "reverse", F.col("pose_id"), F.col("part1"), F.col("intptt")) < p)
    pick = lambda a, to: F.when(turn, to).otherwise(F.col(a))
    return rows.withColumns({"side1": pick("side1", F.col("side2")), "intptt": pick("intptt", F.coalesce(swap[F.col("intptt")], "intptt")), "side2": pick("side2", F.col("side1"))})


#: Categories that two same parts can share as one subject: "both hands are close to each other".
SHARED = (*KINDS["distance"].categories, "touch")


def collapse(rows: DataFrame, p: float = 0.5, seed: int = 0, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """With probability p a distance or contact between two same parts becomes a code of both, without a second part."""
    one = (F.col("part1") == F.col("part2")) & F.col("intptt").isin(*shared) & (uniform(seed, "collapse", F.col("pose_id"), F.col("part1"), F.col("intptt")) < p)
    return rows.withColumns({"side1": F.when(one, "both").otherwise(F.col("side1")), "side2": F.when(~F.coalesce(one, F.lit(False)), F.col("side2")), "part2": F.when(~F.coalesce(one, F.lit(False)), F.col("part2"))})


def needless(part1: Column, intptt: Column, part2: Column) -> Column:
    """Whether a second part only served the measurement: what is behind or in front of the torso, hands beside a shoulder, feet beside a hip, hands above the neck."""
    hand, foot = part1.isin("hand", "hands"), part1.isin("foot", "feet")
    beside = intptt.isin("at_right", "at_left")
    said = (
        ((part2 == "torso") & intptt.isin("behind", "front")) | (hand & (part2 == "shoulder") & beside)
        | (foot & (part2 == "hip") & beside) | ((hand | (part1 == "wrist")) & (part2 == "neck") & (intptt == "above"))
    )
    return F.coalesce(said, F.lit(False))


def omit_second(rows: DataFrame) -> DataFrame:
    """Rows without their needless second parts."""
    keep = ~needless(F.col("part1"), F.col("intptt"), F.col("part2"))
    return rows.withColumns({"side2": F.when(keep, F.col("side2")), "part2": F.when(keep, F.col("part2"))})


def fuse(rows: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Codes of one predicate, or else of one subject, are put together: pose_id, how, key, n.

    Each code goes once: to its predicate's group if that has two codes and is no smaller than
    its subject's, to its subject's if that has two, else it stays alone.  exempt: codes that
    always stay alone and don't count for others.
    """
    predicate, subject = F.concat_ws("|", "intptt", F.coalesce("side2", F.lit("")), F.coalesce("part2", F.lit(""))), F.concat_ws("|", F.coalesce("side1", F.lit("")), "part1")
    r = rows.select("pose_id", predicate.alias("pred"), subject.alias("subj"), (F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))).alias("off"))
    n = lambda c: F.count_if(~F.col("off")).over(Window.partitionBy("pose_id", c))
    r = r.withColumn("np", n("pred")).withColumn("ns", n("subj"))
    how = F.when(F.col("off"), "alone").when((F.col("np") > 1) & (F.col("np") >= F.col("ns")), "predicate").when(F.col("ns") > 1, "subject").otherwise("alone")
    key = F.when(how == "predicate", F.col("pred")).when(how == "subject", F.col("subj")).otherwise(F.concat_ws("#", "subj", "pred"))
    return r.select("pose_id", how.alias("how"), key.alias("key")).groupBy("pose_id", "how", "key").agg(F.count("*").alias("n"))


def contains_rows() -> list[tuple[str, str]]:
    """whole, part: everything that a part contains, at any depth."""
    def below(p: str) -> set[str]:
        own = CONTAINS.get(p, ())
        return set(own).union(*(below(c) for c in own))

    return [(p, c) for p in CONTAINS for c in sorted(below(p))]


def prune_contained(contacts: DataFrame) -> DataFrame:
    """contacts (pose_id, side1, part1, side2, part2): drops one where the same contact of a containing part is there."""
    spark = contacts.sparkSession
    t = spark.createDataFrame([*contains_rows(), *((p, p) for p in {x for r in contains_rows() for x in r})], "whole string, part string")
    t1, t2 = F.broadcast(t.select(F.col("whole").alias("w1"), F.col("part").alias("p1"))), F.broadcast(t.select(F.col("whole").alias("w2"), F.col("part").alias("p2")))
    c = contacts.distinct()
    wider = c.select(F.col("pose_id").alias("p"), F.col("side1").alias("s1"), F.col("part1").alias("w1"), F.col("side2").alias("s2"), F.col("part2").alias("w2"))
    dominated = wider.join(t1, "w1").join(t2, "w2").where("not (w1 = p1 and w2 = p2)").select("p", "s1", "p1", "s2", "p2").distinct()
    on = (F.col("pose_id") == F.col("p")) & F.col("side1").eqNullSafe(F.col("s1")) & (F.col("part1") == F.col("p1")) & F.col("side2").eqNullSafe(F.col("s2")) & (F.col("part2") == F.col("p2"))
    return c.join(dominated, on, "left_anti")


def ordered(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Codes numbered from the trunk outwards; parts of one rank and codes of one part by keyed hash; unknown parts last."""
    spark = rows.sparkSession
    ranks = {}
    for parts in ORDER.values():
        for i, p in enumerate(parts):
            ranks.setdefault(p, i)
    t = F.broadcast(spark.createDataFrame(list(ranks.items()), "part1 string, part_rank int"))
    side_draw = uniform(seed, "side", F.col("pose_id"), F.coalesce("side1", F.lit("")))
    branch = F.when(F.col("part1").isin(ORDER["upper"][2:]), 1).when(F.col("part1").isin(ORDER["lower"][2:]), 2).otherwise(0)
    r = rows.join(t, "part1", "left").withColumn("place", F.row_number().over(Window.partitionBy("pose_id").orderBy(branch, side_draw, F.coalesce("part_rank", F.lit(99)), "part1", "intptt", F.coalesce("side1", F.lit("")), F.coalesce("side2", F.lit("")), F.coalesce("part2", F.lit("")))))
    return r.drop("part_rank")


def merge_contacts(rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Formatted codes and contacts (pose_id, side1, part1, side2, part2) in one: where two parts touch, it isn't said that they are close."""
    key = ("pose_id", "side1", "part1", "side2", "part2")
    c = contacts.select(*(F.col(k).alias(f"c_{k}") for k in key)).distinct()
    on = F.col("intptt") == "close"
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    touch = contacts.select("pose_id", "side1", "part1", F.lit("touch").alias("intptt"), "side2", "part2")
    return rows.select("pose_id", "side1", "part1", "intptt", "side2", "part2").join(c, on, "left_anti").unionByName(touch)


def code_name(kind: Column, side1: Column, part1: Column, intptt: Column, side2: Column, part2: Column) -> Column:
    """A code as `[kind] parts (category)`: `L/R hand`, `L hand-knee`, `L hand - R knee`, `head - neck`, `L knee`, `hands` of both sides."""
    letter = lambda s: F.when(s == "left", "L").when(s == "right", "R")
    one, two = F.concat_ws(" ", letter(side1), part1), F.concat_ws(" ", letter(side2), part2)
    parts = (
        F.when(part2.isNull(), one).when(part1 == part2, F.concat(letter(side1), F.lit("/"), letter(side2), F.lit(" "), part1))
        .when(side1 == side2, F.concat(one, F.lit("-"), part2)).otherwise(F.concat(one, F.lit(" - "), two))
    )
    return F.concat(F.lit("["), kind, F.lit("] "), parts, F.lit(" ("), intptt, F.lit(")"))


def parse_name(name: Column) -> Column:
    """The struct (kind, side1, part1, intptt, side2, part2) behind a name of `code_name`; nulls where it has no such form."""
    found = lambda pattern, n: F.nullif(F.regexp_extract(name, r"^\[([^\]]+)\] " + pattern + r" \(([^()]+)\)$", n), F.lit(""))
    twin, same, apart, single = r"([LR])/([LR]) (\w+)", r"([LR]) (\w+)-(\w+)", r"(?:([LR]) )?(\w+) - (?:([LR]) )?(\w+)", r"(?:([LR]) )?(\w+)"
    first = lambda *at: F.coalesce(*(found(p, n + 1) for p, n in at))
    side = lambda letter, part: F.when(letter == "L", "left").when(letter == "R", "right").when(part.isin("hands", "feet"), "both")
    part1, part2 = first((twin, 3), (same, 2), (apart, 2), (single, 2)), first((twin, 3), (same, 3), (apart, 4))
    return F.struct(
        first((twin, 0), (same, 0), (apart, 0), (single, 0)).alias("kind"),
        side(first((twin, 1), (same, 1), (apart, 1), (single, 1)), part1).alias("side1"),
        part1.alias("part1"),
        first((twin, 4), (same, 4), (apart, 5), (single, 3)).alias("intptt"),
        side(first((twin, 2), (same, 1), (apart, 3)), part2).alias("side2"),
        part2.alias("part2"),
    )
