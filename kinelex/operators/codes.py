"""Pose codes: measured, binned, made eligible, combined and resolved.

Facts are long: one row per pose and code.  The catalogue is a few hundred constant rows, so
it goes into expressions and literal tables and never grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.exprs import bin_of, let, uniform
from ..functions.shipping import ship
from ..functions.stages import stored
from ..plans import catalog
from ..plans.catalog import AT, CODES, KINDS

POSITION_KINDS = tuple(k for k in KINDS if not k.startswith("relativeRot"))


def _value(kind: str, j: Column, a: Column, b: Column, d: Column, floor: Column) -> Column:
    """The measurement of one code; j: joints; a, b, d: the code's points; floor: the lowest joint's height."""
    if kind == "angle":
        return g.degrees_of_cos(g.dot(g.unit(g.sub(a, b)), g.unit(g.sub(d, b))))
    if kind == "distance":
        return g.distance(a, b)
    if kind.startswith("relativePos"):
        axis = kind[-1].lower()
        return a[axis] - b[axis]
    if kind == "relativeVAxis":
        return g.degrees_of_cos(F.abs(g.unit(g.sub(b, a))["y"]))
    if kind == "onGround":
        return a["y"] - floor
    left, right, pelvis = (j[AT[n]] for n in ("left_shoulder", "right_shoulder", "pelvis"))
    up = g.sub(g.mean(left, right), pelvis)
    if kind == "bodyInclineX":
        n = F.greatest(F.sqrt(up["y"] * up["y"] + up["z"] * up["z"]), F.lit(1e-12))
        return F.when(upright(j), g.degrees_of_cos(up["y"] / n) * F.signum(up["z"])).otherwise(0.0)
    if kind == "bodyInclineY":
        line = g.sub(left, right)
        n = F.greatest(F.sqrt(line["x"] * line["x"] + line["z"] * line["z"]), F.lit(1e-12))
        return g.degrees_of_cos(line["x"] / n) * F.signum(line["z"])
    return 90.0 - g.degrees_of_cos(g.unit(up)["x"])


def upright(j: Column) -> Column:
    """The lower ankle is over 0.2 m below the middle of the shoulders."""
    middle = (j[AT["left_shoulder"]]["y"] + j[AT["right_shoulder"]]["y"]) / 2
    return F.least(j[AT["left_ankle"]]["y"], j[AT["right_ankle"]]["y"]) < middle - 0.2


def _literals(kinds: tuple[str, ...], only: frozenset[int] | None) -> str:
    """The codes to measure as a constant array of (code_id, kind's number, joint numbers a, b, d)."""
    rows = []
    for i, c in enumerate(CODES):
        if c.kind in kinds and (only is None or i in only):
            at = [AT[x] for x in c.joints[:3]]
            at += [at[0]] * (3 - len(at))
            rows.append(f"named_struct('code_id', {i}, 'k', {kinds.index(c.kind)}, 'a', {at[0]}, 'b', {at[1]}, 'd', {at[2]})")
    return f"array({', '.join(rows)})"


def by_pose(poses: DataFrame) -> DataFrame:
    """poses dealt by pose_id: what is measured next is grouped and joined by it, so the few columns here move instead of hundreds of facts."""
    return poses.repartition(int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pose_id")


def measure(poses: DataFrame, kinds: tuple[str, ...] = POSITION_KINDS, noise_seed: int | None = None, only: frozenset[int] | None = None) -> DataFrame:
    """poses (pose_id, joints) -> pose_id, code_id, kind, value, bin, intptt_id.

    noise_seed: adds uniform noise up to the kind's amplitude to each value, keyed by pose and
    code; None: exact values.  only: numbers of the codes to measure, others are not computed.
    intptt_id is the bin's number among all categories.
    """
    lowest = F.array_min(F.transform("joints", lambda p: p["y"])) if "onGround" in kinds else F.lit(0.0)
    p = by_pose(poses.select("pose_id", "joints")).withColumn("floor", lowest)
    p = p.select("pose_id", "joints", "floor", F.explode(F.expr(_literals(kinds, only))).alias("c")).select("pose_id", "joints", "floor", "c.*")
    j = F.col("joints")
    # plain columns over one row per code: the expressions are compiled, as no lambda holds them

    def by_kind(what: Callable[[str], Column]) -> Column:
        """The last kind is the `otherwise`: a column that can't be null draws no null filter, which the optimizer would push below all this."""
        out = None
        for n, kind in enumerate(kinds[:-1]):
            out = F.when(F.col("k") == n, what(kind)) if out is None else out.when(F.col("k") == n, what(kind))
        return what(kinds[-1]) if out is None else out.otherwise(what(kinds[-1]))

    value = by_kind(lambda kind: _value(kind, j, j[F.col("a")], j[F.col("b")], j[F.col("d")], F.col("floor")))
    if noise_seed is not None:
        value = value + (2 * uniform(noise_seed, "noise", F.col("pose_id"), F.col("code_id")) - 1) * by_kind(lambda kind: F.lit(float(KINDS[kind].noise)))
    facts = p.select("pose_id", "code_id", "k", (value + 0.0).alias("value"))
    offset = by_kind(lambda kind: F.lit(catalog.OFFSET[kind])).alias("offset")
    facts = facts.select("pose_id", "code_id", by_kind(lambda kind: F.lit(kind)).alias("kind"), "value", by_kind(lambda kind: bin_of(F.col("value"), KINDS[kind].thresholds)).alias("bin"), offset)
    return facts.select("pose_id", "code_id", "kind", "value", "bin", (F.col("bin") + F.col("offset")).alias("intptt_id"))


def measure_rotations(rotations: DataFrame) -> DataFrame:
    """rotations (pose_id, body: rotation vectors) -> the three head rotation codes, as `measure` returns them."""
    out = []
    for axis in "XYZ":
        kind = f"relativeRot{axis}"
        code = next(c for c in CODES if c.kind == kind)
        q = g.composed(F.col("body"), g.chain_between(*code.joints))
        v = let(q, lambda q: F.degrees(g.euler(q)[axis.lower()])) + 0.0  # noqa: B023
        out.append(rotations.select("pose_id", F.lit(catalog.CODE_ID[kind, code.joints]).alias("code_id"), F.lit(kind).alias("kind"), v.alias("value")).withColumn("bin", bin_of(F.col("value"), KINDS[kind].thresholds)))
    union = out[0].unionByName(out[1]).unionByName(out[2])
    return union.withColumn("intptt_id", F.col("bin") + F.create_map(*(F.lit(x) for a in "XYZ" for x in (f"relativeRot{a}", catalog.OFFSET[f"relativeRot{a}"])))[F.col("kind")])


def code_table(spark: SparkSession) -> DataFrame:
    """code_id, kind, focus, intptt_id, intptt, accepted, rare, support, absolute: what the catalogue says of each category of each code."""
    rows = [
        (i, c.kind, c.focus, catalog.OFFSET[c.kind] + n, name, int(name in c.accepted), int(name in c.rare), dict(c.support).get(name, 0), int(name in c.absolute))
        for i, c in enumerate(CODES)
        for n, name in enumerate(KINDS[c.kind].categories)
    ]
    return spark.createDataFrame(rows, "code_id int, kind string, focus string, intptt_id int, intptt string, accepted int, rare int, support int, absolute int")


def requirement_table(spark: SparkSession) -> DataFrame:
    """super_id, way, n_required, code_id, intptt_id, rare: one row per requirement of each super-code."""
    rows = [
        (i, w, len(way), catalog.CODE_ID[kind, joints], catalog.OFFSET[kind] + KINDS[kind].categories.index(category), int(s.rare))
        for i, s in enumerate(catalog.SUPERS)
        for w, way in enumerate(s.ways)
        for kind, joints, category in way
    ]
    return spark.createDataFrame(rows, "super_id int, way int, n_required int, code_id int, intptt_id int, rare int")


def eligibility(facts: DataFrame) -> DataFrame:
    """facts plus elig: 0, 1 (accepted) or 2 (accepted and rare)."""
    table = F.broadcast(code_table(facts.sparkSession).select("code_id", "intptt_id", (F.col("accepted") + F.col("rare")).alias("elig")))
    return facts.join(table, ["code_id", "intptt_id"], "left").withColumn("elig", F.coalesce("elig", F.lit(0)))


def super_codes(facts: DataFrame) -> DataFrame:
    """pose_id, super_id, elig (1, or 2 if rare) of the super-codes that hold: some way has all of its requirements."""
    req = F.broadcast(requirement_table(facts.sparkSession))
    met = facts.select("pose_id", "code_id", "intptt_id").join(req, ["code_id", "intptt_id"])
    ways = met.groupBy("pose_id", "super_id", "way").agg(F.count("*").alias("met"), F.max("n_required").alias("n"), F.max("rare").alias("rare"))
    return ways.where("met = n").groupBy("pose_id", "super_id").agg((F.max("rare") + 1).alias("elig"))


def resolve_support(eligible: DataFrame, supers: DataFrame, strict: bool = False) -> DataFrame:
    """eligible with the support categories settled.

    A category of support type 1 never stands by itself; one of type 2 gives way where a
    super-code that names it holds.  Only categories that some super-code names are looked at,
    unless `strict`, which drops every category of type 1.
    """
    spark = eligible.sparkSession
    table = code_table(spark).select("code_id", "intptt_id", "support").where("support > 0")
    named = requirement_table(spark).select("super_id", "code_id", "intptt_id").distinct()
    first = table.where("support = 1").select("code_id", "intptt_id")
    if not strict:
        first = first.join(named.select("code_id", "intptt_id").distinct(), ["code_id", "intptt_id"])
    fired = supers.select("pose_id", "super_id").join(F.broadcast(named.join(table.where("support = 2"), ["code_id", "intptt_id"])), "super_id").select("pose_id", "code_id", "intptt_id").distinct()
    e = eligible.join(F.broadcast(first.withColumn("__one", F.lit(True))), ["code_id", "intptt_id"], "left")
    e = e.join(fired.withColumn("__two", F.lit(True)), ["pose_id", "code_id", "intptt_id"], "left")
    return e.withColumn("elig", F.when(F.col("__one") | F.col("__two"), 0).otherwise(F.col("elig"))).drop("__one", "__two")


def with_supers(eligible: DataFrame, supers: DataFrame) -> DataFrame:
    """pose_id, code_id, intptt_id, elig of eligible codes and of super-codes; the latter are numbered after the codes."""
    t = F.broadcast(eligible.sparkSession.createDataFrame([(i, catalog.CATEGORIES.index(s.category)) for i, s in enumerate(catalog.SUPERS)], "super_id int, intptt_id int"))
    more = supers.join(t, "super_id").select("pose_id", (F.col("super_id") + len(CODES)).alias("code_id"), "intptt_id", "elig")
    return eligible.select("pose_id", "code_id", "intptt_id", "elig").unionByName(more)


def super_stats(supers: DataFrame, poses: DataFrame) -> DataFrame:
    """super_id, share of poses (percent), verdict: unskippable under 6, eligible under 40, else ignored."""
    n = poses.agg(F.count("*").alias("n_poses"))
    shares = supers.groupBy("super_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("super_id", (100.0 * F.col("n") / F.col("n_poses")).alias("share"))
    return shares.withColumn("verdict", F.when(F.col("share") < 6, "unskippable").when(F.col("share") < 40, "eligible").otherwise("ignored"))


def code_frequency(facts: DataFrame, poses: DataFrame) -> DataFrame:
    """code_id, intptt_id, share of poses, and how common that is."""
    n = poses.agg(F.count("*").alias("n_poses"))
    t = code_table(facts.sparkSession).select("code_id", "intptt_id", "accepted")
    out = facts.groupBy("code_id", "intptt_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("code_id", "intptt_id", (F.col("n") / F.col("n_poses")).alias("share"))
    out = out.join(F.broadcast(t), ["code_id", "intptt_id"])
    verdict = F.when(F.col("accepted") == 0, "ignored").when(F.col("share") > 0.4, "frequent").when(F.col("share") > 0.06, "usual").otherwise("rare")
    return out.select("code_id", "intptt_id", "share", verdict.alias("verdict"))


def wanted_codes(wanted: list[tuple[str, tuple[str, ...], str]]) -> frozenset[int]:
    """What `measure` has to compute for a search."""
    return frozenset(catalog.CODE_ID[kind, joints] for kind, joints, _ in wanted)


def search(facts: DataFrame, wanted: list[tuple[str, tuple[str, ...], str]], k: int | None = 5, seed: int = 0) -> DataFrame:
    """Poses that meet all (kind, joints, category); k of them drawn by a keyed hash, None: all."""
    rows = [(n, catalog.CODE_ID[kind, joints], catalog.OFFSET[kind] + KINDS[kind].categories.index(category)) for n, (kind, joints, category) in enumerate(wanted)]
    table = F.broadcast(facts.sparkSession.createDataFrame(rows, "req int, code_id int, intptt_id int"))
    # no filter on the category: it would be pushed into the measurement and repeat it for every threshold
    found = facts.join(table, ["code_id", "intptt_id"], "left").groupBy("pose_id").agg(F.count_distinct("req").alias("n")).where(F.col("n") == len(wanted))
    found = found.select("pose_id", uniform(seed, "search", F.col("pose_id")).alias("draw"))
    return found if k is None else found.orderBy("draw", "pose_id").limit(k)


def skip(eligible: DataFrame, p: float = 0.15, seed: int = 0) -> DataFrame:
    """Eligible facts plus kept: rare ones always, others unless their draw is below p; a pose that would lose all keeps all."""
    e = eligible.where("elig > 0").withColumn("kept", (F.col("elig") == 2) | (uniform(seed, "skip", F.col("pose_id"), F.col("code_id")) >= p))
    some = F.max("kept").over(Window.partitionBy("pose_id"))
    return e.withColumn("kept", F.col("kept") | ~some)


def rule_mining(facts: DataFrame, confidence: float = 0.7, support: int = 50) -> DataFrame:
    """Rules a => b between accepted categories of one pose, by how many poses have a and a share of those b."""
    t = F.broadcast(code_table(facts.sparkSession).where("accepted = 1").select("code_id", "intptt_id"))
    f = facts.join(t, ["code_id", "intptt_id"]).select("pose_id", (F.col("code_id") * 1000 + F.col("intptt_id")).alias("item"))
    single = f.groupBy("item").agg(F.count("*").alias("n_a")).where(F.col("n_a") >= support)
    f = f.join(F.broadcast(single), "item")
    pairs = f.alias("a").join(f.alias("b"), "pose_id").where("a.item <> b.item").groupBy(F.col("a.item").alias("a"), F.col("b.item").alias("b")).agg(F.count("*").alias("n"), F.max("a.n_a").alias("n_a"))
    return pairs.where((F.col("n") >= support) & (F.col("n") >= confidence * F.col("n_a"))).select("a", "b", F.col("n"), (F.col("n") / F.col("n_a")).alias("confidence"))


def _items(facts: DataFrame, support: int) -> DataFrame:
    """pose_id, item: accepted categories that at least `support` poses have, as one number each."""
    t = F.broadcast(code_table(facts.sparkSession).where("accepted = 1").select("code_id", "intptt_id"))
    f = facts.join(t, ["code_id", "intptt_id"]).select("pose_id", (F.col("code_id") * 1000 + F.col("intptt_id")).alias("item"))
    often = f.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("item")
    return f.join(F.broadcast(often), "item")


def mirror_rows() -> list[tuple[int, int]]:
    """item, item: each accepted category and the one that says the same of the other side."""
    from .rewrite import mirrored_code

    number = lambda c: catalog.CODE_ID[c[0], c[1]] * 1000 + catalog.OFFSET[c[0]] + KINDS[c[0]].categories.index(c[2])
    rows = [((c.kind, c.joints, x), mirrored_code((c.kind, c.joints, x))) for c in CODES for x in c.accepted]
    return [(number(a), number(b)) for a, b in rows]


def symmetric(rules: DataFrame, *columns: str) -> DataFrame:
    """Those of the rules over items whose mirror image is a rule too; the items before the last may change places."""
    m = F.broadcast(rules.sparkSession.createDataFrame(mirror_rows(), "item int, other int"))
    image = rules.select(*columns)
    for c in columns:
        image = image.join(m.select(F.col("item").alias(c), F.col("other").alias(f"m_{c}")), c)
    *given, said = (F.col(f"m_{c}") for c in columns)
    sides = [F.least(*given), F.greatest(*given)] if len(given) > 1 else given
    return rules.join(image.select(*(x.alias(c) for x, c in zip([*sides, said], columns, strict=True))).distinct(), list(columns), "left_semi")


def _together(items: DataFrame, confidence: float, support: int, bi_confidence: float) -> DataFrame:
    """items (pose_id, item) -> a, b, c, n, n_ab of the rules a, b => c (a < b), and a, b, b, n_ab, n_a of the rules a => b.

    A pose's items, one short row, go to the group of each of them.  The poses of a's group pass in
    batches; what is kept of them is a matrix of how many have b and c, as large as the catalogue squared.
    """
    ship(items.sparkSession)
    known = np.array(sorted({x for x, _ in mirror_rows()}))

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n = key[0].as_py(), np.zeros((len(known), len(known)), np.int64)
        for batch in batches:
            lists = batch.column("items")
            x = np.zeros((batch.num_rows, len(known)), np.float32)  # whole numbers up to 2 ** 24 are exact
            x[np.repeat(np.arange(len(lists)), lists.value_lengths()), np.searchsorted(known, lists.flatten())] = 1
            n += (x.T @ x).astype(np.int64)
        at = int(np.searchsorted(known, a))
        n_ab = np.diag(n)
        three = (n >= support) & (n >= confidence * n_ab[:, None]) & (np.arange(len(known)) > at)[:, None]
        three[:, at] = False
        np.fill_diagonal(three, False)
        two = np.flatnonzero((n_ab >= support) & (n_ab >= bi_confidence * n_ab[at]) & (np.arange(len(known)) != at))
        b, c = np.nonzero(three)
        b, c, of = np.concatenate([b, two]), np.concatenate([c, two]), np.concatenate([n_ab[b], np.full(len(two), n_ab[at])])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(b), a, np.int32), known[b].astype(np.int32), known[c].astype(np.int32), n[b, c], of)], ["a", "b", "c", "n", "n_ab"])

    pose = items.groupBy("pose_id").agg(F.collect_list("item").alias("items"))
    dealt = pose.select(F.explode("items").alias("a"), F.transform("items", lambda x: x.cast("int")).alias("items"))
    return dealt.groupBy("a").applyInArrow(count, "a int, b int, c int, n long, n_ab long")


def tri_rules(facts: DataFrame, confidence: float = 0.8, support: int = 50, bi_confidence: float = 0.7) -> DataFrame:
    """Rules a, b => c (a < b) between accepted categories of one pose: a, b, c, n (poses that have all three), confidence.

    A rule that adds b to a mined rule a => c says nothing new and is left out; a rule must hold for
    the other side of the body too.
    """
    counts = stored(_together(_items(facts, support), confidence, support, bi_confidence), "together")
    mined = symmetric(counts.where("b = c").select("a", "c", "n"), "a", "c").select("a", "c")
    found = counts.where("b <> c").join(mined, ["a", "c"], "left_anti").join(mined.select(F.col("a").alias("b"), "c"), ["b", "c"], "left_anti")
    return symmetric(stored(found.select("a", "b", "c", "n", (F.col("n") / F.col("n_ab")).alias("confidence")), "rules"), "a", "b", "c")
