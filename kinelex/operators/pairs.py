"""Pair codes: what changes from pose A to pose B.

Every value is A's minus B's, so a positive change in y means lower in B.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bin_of, uniform
from ..plans import catalog
from ..plans.catalog import AT, PAIR_CODES, PAIR_KINDS
from .codes import code_table, upright


def pairs_of(poses: DataFrame) -> DataFrame:
    """pair_id, pose_a, pose_b for the pairs (2k, 2k + 1)."""
    ids = poses.select("pose_id")
    a = ids.where("pose_id % 2 = 0").select((F.col("pose_id") / 2).cast("long").alias("pair_id"), F.col("pose_id").alias("pose_a"))
    return a.join(ids.select(F.col("pose_id").alias("pose_b")), F.col("pose_b") == F.col("pose_a") + 1)


def _binned(df: DataFrame) -> DataFrame:
    b = None
    for kind, k in PAIR_KINDS.items():
        v = bin_of(F.col("value"), k.thresholds) + catalog.PAIR_OFFSET[kind]
        b = F.when(F.col("kind") == kind, v) if b is None else b.when(F.col("kind") == kind, v)
    return df.withColumn("intptt_id", b)


def codes_behind(kinds: tuple[str, ...]) -> frozenset[int]:
    """Numbers of the pose codes whose values these kinds of changes compare."""
    known = {(c.kind.removeprefix("pair_"), c.joints) for c in PAIR_CODES if c.kind in kinds}
    return frozenset(catalog.CODE_ID[x] for x in known if x in catalog.CODE_ID)


def change(facts: DataFrame, pairs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """facts (measured pose codes), pairs -> pair_id, code_id, kind, value, intptt_id for codes whose change is a difference of pose values."""
    spark = facts.sparkSession
    rows = [(i, c.kind, catalog.CODE_ID[c.kind.removeprefix("pair_"), c.joints]) for i, c in enumerate(PAIR_CODES) if c.kind in kinds]
    t = F.broadcast(spark.createDataFrame(rows, "pair_code int, pair_kind string, code_id int"))
    f = facts.join(t, "code_id").select("pose_id", "pair_code", "pair_kind", "value")
    a = pairs.join(f, F.col("pose_a") == F.col("pose_id")).select("pair_id", "pose_b", "pair_code", "pair_kind", F.col("value").alias("va"))
    b = f.select(F.col("pose_id").alias("pose_b"), F.col("pair_code").alias("code_b"), F.col("value").alias("vb"))
    out = a.join(b, (a["pose_b"] == b["pose_b"]) & (F.col("pair_code") == F.col("code_b")))
    return _binned(out.select("pair_id", F.col("pair_code").alias("code_id"), F.col("pair_kind").alias("kind"), (F.col("va") - F.col("vb") + 0.0).alias("value")))


def with_joints(poses: DataFrame, pairs: DataFrame) -> DataFrame:
    a = poses.select(F.col("pose_id").alias("pose_a"), F.col("joints").alias("ja"))
    b = poses.select(F.col("pose_id").alias("pose_b"), F.col("joints").alias("jb"))
    return pairs.join(a, "pose_a").join(b, "pose_b")


def moved(poses: DataFrame, pairs: DataFrame) -> DataFrame:
    """The relative position kinds: where a joint is in A against where it is in B."""
    rows = [F.struct(F.lit(i).alias("code_id"), F.lit(c.kind).alias("kind"), F.lit(AT[c.joints[0]]).alias("j"), F.lit(c.kind[-1]).alias("axis")) for i, c in enumerate(PAIR_CODES) if "relativePos" in c.kind]
    p = with_joints(poses, pairs).select("pair_id", F.explode(F.transform(F.array(*rows), lambda c: F.struct(c["code_id"], c["kind"], sum_axis(c).alias("value")))).alias("f"))
    return _binned(p.select("pair_id", "f.*"))


def sum_axis(c):
    a, b = F.col("ja")[c["j"]], F.col("jb")[c["j"]]
    return F.when(c["axis"] == "X", a["x"] - b["x"]).when(c["axis"] == "Y", a["y"] - b["y"]).otherwise(a["z"] - b["z"]) + 0.0


def inclined(facts: DataFrame, poses: DataFrame, pairs: DataFrame) -> DataFrame:
    """The body inclination kinds; forward inclination counts as unchanged where either pose isn't upright."""
    d = change(facts, pairs, ("pair_bodyInclineX", "pair_bodyInclineY", "pair_bodyInclineZ"))
    u = poses.select("pose_id", upright(F.col("joints")).alias("up"))
    ok = pairs.join(u.select(F.col("pose_id").alias("pose_a"), F.col("up").alias("ua")), "pose_a").join(u.select(F.col("pose_id").alias("pose_b"), F.col("up").alias("ub")), "pose_b")
    d = d.join(ok.select("pair_id", (F.col("ua") & F.col("ub")).alias("both")), "pair_id")
    value = F.when((F.col("kind") == "pair_bodyInclineX") & ~F.col("both"), 0.0).otherwise(F.col("value"))
    return _binned(d.select("pair_id", "code_id", "kind", value.alias("value")))


def root_rotation(changes: DataFrame) -> DataFrame:
    """pair_id, degrees -> the bin of a turn; half a turn either way is one bin."""
    b = bin_of(F.col("degrees"), catalog.ROOT_ROTATION.thresholds)
    last = len(catalog.ROOT_ROTATION.thresholds)
    return changes.select("pair_id", "degrees", F.when(b == last, 0).otherwise(b).alias("bin"))


def direction_table(spark: SparkSession) -> DataFrame:
    """intptt_id, nature (the id of the kind's unchanged middle), direction and magnitude around it."""
    rows = []
    for kind, k in PAIR_KINDS.items():
        middle = next(i for i, c in enumerate(k.categories) if "ignored" in c)
        for i in range(len(k.categories)):
            d = i - middle
            rows.append((catalog.PAIR_OFFSET[kind] + i, kind, catalog.PAIR_OFFSET[kind] + middle, (d > 0) - (d < 0), abs(d)))
    return spark.createDataFrame(rows, "intptt_id int, kind string, nature int, direction int, magnitude int")


def requirement_rows() -> list[tuple]:
    """super_id, way, n_required, role, code_id, wanted: category id for poses and strict, direction -1 or 1 otherwise."""
    rows = []
    for i, s in enumerate(catalog.SUPER_PAIRS):
        for w, way in enumerate(s.ways):
            for role, kind, joints, category in way:
                if role in "ab":
                    rows.append((i, w, len(way), role, catalog.CODE_ID[kind, joints], catalog.OFFSET[kind] + catalog.KINDS[kind].categories.index(category)))
                else:
                    names = PAIR_KINDS[kind].categories
                    at, middle = names.index(category), next(n for n, c in enumerate(names) if "ignored" in c)
                    rows.append((i, w, len(way), role, catalog.PAIR_CODE_ID[kind, joints], catalog.PAIR_OFFSET[kind] + at if role == "strict" else (at > middle) - (at < middle)))
    return rows


def super_pairs(pose_facts: DataFrame, pair_facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, super_id of the super-pair-codes that hold."""
    spark = pose_facts.sparkSession
    req = spark.createDataFrame(requirement_rows(), "super_id int, way int, n_required int, role string, code_id int, wanted int")
    directions = F.broadcast(direction_table(spark).select("intptt_id", "direction"))
    needed = F.broadcast(req.where("role in ('a', 'b')").select("role", "code_id", F.col("wanted").alias("intptt_id"), "super_id", "way", "n_required"))
    held = pose_facts.select("pose_id", "code_id", "intptt_id").join(needed, ["code_id", "intptt_id"])
    ends = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("a").alias("role"), F.col("pose_a").alias("pose_id")), F.struct(F.lit("b").alias("role"), F.col("pose_b").alias("pose_id")))).alias("e")).select("pair_id", "e.role", "e.pose_id")
    of_poses = held.join(ends, ["pose_id", "role"]).select("pair_id", "super_id", "way", "n_required")
    p = pair_facts.join(directions, "intptt_id").select("pair_id", "code_id", "intptt_id", "direction")
    r = F.broadcast(req.where("role in ('strict', 'direction')"))
    meets = F.when(r["role"] == "strict", F.col("intptt_id") == F.col("wanted")).otherwise((F.col("direction") == F.col("wanted")) & (F.col("direction") != 0))
    of_pairs = p.join(r, "code_id").where(meets).select("pair_id", "super_id", "way", "n_required")
    met = of_poses.unionByName(of_pairs).groupBy("pair_id", "super_id", "way").agg(F.count("*").alias("n"), F.max("n_required").alias("need"))
    return met.where("n = need").select("pair_id", "super_id").distinct()


def pair_code_table(spark: SparkSession) -> DataFrame:
    """code_id, intptt_id, accepted, rare, side1, part1, side2, part2, nature, direction, magnitude: what the catalogue says of each category of each pair code."""
    rows = []
    for i, c in enumerate(PAIR_CODES):
        names = PAIR_KINDS[c.kind].categories
        middle = next(n for n, x in enumerate(names) if "ignored" in x)
        first = c.focus or c.joints[0]
        second = next((j for j in c.joints[::-1] if j != first), None) if c.kind == "pair_distance" else None
        for n, x in enumerate(names):
            d = n - middle
            rows.append((i, catalog.PAIR_OFFSET[c.kind] + n, int(x in c.accepted), int(x in c.rare), *catalog.split_side(first), *catalog.split_side(second), catalog.PAIR_OFFSET[c.kind] + middle, (d > 0) - (d < 0), abs(d)))
    return spark.createDataFrame(rows, "code_id int, intptt_id int, accepted int, rare int, side1 string, part1 string, side2 string, part2 string, nature int, direction int, magnitude int")


def pair_eligibility(facts: DataFrame) -> DataFrame:
    """Pair facts plus elig: 0, 1 (accepted) or 2 (accepted and rare)."""
    t = F.broadcast(pair_code_table(facts.sparkSession).select("code_id", "intptt_id", (F.col("accepted") + F.col("rare")).alias("elig")))
    return facts.join(t, ["code_id", "intptt_id"], "left").withColumn("elig", F.coalesce("elig", F.lit(0)))


def absolute_eligibility(facts: DataFrame) -> DataFrame:
    """Pose facts plus elig as pairs see them: 1 for a category of absolute information, 2 if it is rare as well, else 0."""
    t = F.broadcast(code_table(facts.sparkSession).select("code_id", "intptt_id", (F.col("absolute") * (1 + F.col("rare"))).alias("elig")))
    return facts.join(t, ["code_id", "intptt_id"], "left").withColumn("elig", F.coalesce("elig", F.lit(0)))


def support_rows() -> list[tuple[int, int, int, int]]:
    """super_id, code_id, intptt_id, type: the pair categories that a super-pair-code names and that are its supports.

    A requirement of a direction names every category of that sign.
    """
    rows = set()
    for super_id, _, _, role, code_id, wanted in requirement_rows():
        if role in ("strict", "direction"):
            c = PAIR_CODES[code_id]
            names, offset = PAIR_KINDS[c.kind].categories, catalog.PAIR_OFFSET[c.kind]
            middle = next(n for n, x in enumerate(names) if "ignored" in x)
            sign = lambda n: (n > middle) - (n < middle)  # noqa: B023, E731
            same = (lambda n: offset + n == wanted) if role == "strict" else (lambda n: sign(n) == wanted)  # noqa: B023
            types = {t for x, t in c.support if same(names.index(x))}
            rows |= {(super_id, code_id, offset + n, min(types)) for n in range(len(names)) if types and same(n)}
    return sorted(rows)


def resolve_pair_support(eligible: DataFrame, supers: DataFrame) -> DataFrame:
    """Eligible pair facts with supports settled: type 1 never stands, type 2 gives way where a super-pair-code that names it holds."""
    t = eligible.sparkSession.createDataFrame(support_rows(), "super_id int, code_id int, intptt_id int, type int")
    first = F.broadcast(t.where("type = 1").select("code_id", "intptt_id").distinct().withColumn("__one", F.lit(True)))
    fired = supers.join(F.broadcast(t.where("type = 2")), "super_id").select("pair_id", "code_id", "intptt_id").distinct().withColumn("__two", F.lit(True))
    e = eligible.join(first, ["code_id", "intptt_id"], "left").join(fired, ["pair_id", "code_id", "intptt_id"], "left")
    return e.withColumn("elig", F.when(F.col("__one") | F.col("__two"), 0).otherwise(F.col("elig"))).drop("__one", "__two")


def resolve_pose_support(eligible: DataFrame, supers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Absolute pose facts settled: one gives way where a super-pair-code of a pair of its pose, in the role that names it, holds."""
    rows = [(s, role, code, wanted) for s, _, _, role, code, wanted in requirement_rows() if role in "ab"]
    t = F.broadcast(eligible.sparkSession.createDataFrame(sorted(set(rows)), "super_id int, role string, code_id int, intptt_id int"))
    held = supers.join(pairs, "pair_id").join(t, "super_id")
    gone = held.select(F.when(F.col("role") == "a", F.col("pose_a")).otherwise(F.col("pose_b")).alias("pose_id"), "code_id", "intptt_id").distinct().withColumn("__gone", F.lit(True))
    return eligible.join(gone, ["pose_id", "code_id", "intptt_id"], "left").withColumn("elig", F.when(F.col("__gone"), 0).otherwise(F.col("elig"))).drop("__gone")


def formatted(eligible: DataFrame) -> DataFrame:
    """Eligible pair facts with their parts, nature, direction and magnitude."""
    t = F.broadcast(pair_code_table(eligible.sparkSession).drop("accepted", "rare"))
    return eligible.where("elig > 0").join(t, ["code_id", "intptt_id"]).select("pair_id", "code_id", "side1", "part1", "intptt_id", "nature", "direction", "magnitude", "side2", "part2")


def merge_entities(rows: DataFrame, entities: tuple[tuple[str, str, str], ...], p: float = 1.0, seed: int = 0) -> DataFrame:
    """Two codes of one nature and direction become one, with the larger change, where parts of theirs make a larger part.

    The sides of first and second parts must be the same in both.  Either the first parts make one and
    the second parts are equal, or the other way round, or both make one.  Every such pair of codes is
    replaced with probability p; where several make the same code, the largest change stays.  rows have the
    category as `intptt` or `intptt_id`; what comes of them is distinct.
    """
    name = "intptt" if "intptt" in rows.columns else "intptt_id"
    t = F.broadcast(rows.sparkSession.createDataFrame([*entities, *((y, x, e) for x, y, e in entities)], "x string, y string, entity string"))
    same = ("side1", "nature", "direction", "side2")
    own = (*same, "part1", "part2", "code_id", name, "magnitude")
    a = rows.select("pair_id", *(F.col(c).alias(f"{c}_a") for c in own))
    on = F.col("code_id_a") < F.col("code_id")
    for c in same:
        on = on & F.col(f"{c}_a").eqNullSafe(F.col(c))
    both = a.join(rows.select("pair_id", *own), "pair_id").where(on & ((F.col("direction") != 0) | (F.col(f"{name}_a") == F.col(name))))
    for i, n in enumerate(("part1", "part2")):
        both = both.join(t.select(F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("entity").alias(f"e{i}")), (F.col(f"{n}_a") == F.col(f"x{i}")) & (F.col(n) == F.col(f"y{i}")), "left")
    alike = [F.col(f"{n}_a").eqNullSafe(F.col(n)) for n in ("part1", "part2")]
    made = (F.col("e0").isNotNull() & (alike[1] | F.col("e1").isNotNull())) | (F.col("e1").isNotNull() & alike[0])
    both = both.where(made & (uniform(seed, "entity", F.col("pair_id"), F.col("code_id_a"), F.col("code_id")) < p))
    larger = F.max(F.struct(F.greatest("magnitude_a", "magnitude").alias("m"), F.when(F.col("magnitude") > F.col("magnitude_a"), F.col(name)).otherwise(F.col(f"{name}_a")).alias("c")))
    merged = both.groupBy("pair_id", "side1", "nature", "direction", "side2", F.coalesce("e0", "part1").alias("part1"), F.coalesce("e1", "part2").alias("part2")).agg(larger.alias("x"))
    gone = both.select("pair_id", F.explode(F.array("code_id_a", "code_id")).alias("code_id")).distinct()
    columns = ("pair_id", "side1", "part1", name, "side2", "part2")
    return rows.join(gone, ["pair_id", "code_id"], "left_anti").select(*columns).unionByName(merged.withColumn(name, F.col("x.c")).select(*columns)).distinct()


def search(facts: DataFrame, wanted: list[tuple[str, tuple[str, ...], str]]) -> DataFrame:
    """Pairs that meet all (kind, joints, category)."""
    hits = None
    for n, (kind, joints, category) in enumerate(wanted):
        met = (F.col("code_id") == catalog.PAIR_CODE_ID[kind, joints]) & (F.col("intptt_id") == catalog.PAIR_OFFSET[kind] + PAIR_KINDS[kind].categories.index(category))
        hits = F.when(met, n) if hits is None else hits.when(met, n)
    return facts.withColumn("req", hits).where("req is not null").groupBy("pair_id").agg(F.count_distinct("req").alias("n")).where(F.col("n") == len(wanted)).select("pair_id")


def contact_delta(pairs: DataFrame, contacts: DataFrame) -> DataFrame:
    """pair_id, part1, part2: contacts of pose B that pose A lacks."""
    b = pairs.join(contacts, F.col("pose_b") == F.col("pose_id")).select("pair_id", "pose_a", "part1", "part2").distinct()
    a = contacts.select(F.col("pose_id").alias("pose_a"), "part1", "part2")
    return b.join(a, ["pose_a", "part1", "part2"], "left_anti").select("pair_id", "part1", "part2")


# Body parts from the trunk outwards, one list for each branch.
ORDER = {
    "upper": ("body", "torso", "arm", "shoulder", "upperarm", "elbow", "forearm", "wrist", "hand", "index"),
    "lower": ("body", "torso", "leg", "hip", "thigh", "knee", "lowerleg", "shin", "ankle", "foot", "toes"),
}


def order_rows() -> list[tuple[str, str, int]]:
    """part, branch, rank; parts beyond the torso carry their side."""
    return [
        (p if p in ("body", "torso") else f"{s}_{p}", f"{s}_{branch}", i)
        for s in catalog.SIDES
        for branch, parts in ORDER.items()
        for i, p in enumerate(parts)
    ]


def facts_of_b(changed: DataFrame, facts: DataFrame) -> DataFrame:
    """changed (pair_id, part), facts (pair_id, code_id, part) -> the facts about a changed part or one further out on the same branch."""
    o = F.broadcast(facts.sparkSession.createDataFrame(order_rows(), "part string, branch string, rank int"))
    c = changed.distinct()
    same = facts.join(c, ["pair_id", "part"], "left_semi")
    reach = c.join(o, "part").select("pair_id", "branch", F.col("rank").alias("from_rank"))
    below = facts.join(o, "part").join(reach, ["pair_id", "branch"]).where("rank > from_rank").select(*facts.columns)
    return same.select(*facts.columns).unionByName(below).distinct()
