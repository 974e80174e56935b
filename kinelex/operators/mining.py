"""Mining of diverse poses and informative pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.exprs import uniform
from ..functions.stages import shared_dir, stored
from . import blocks, text


def mpje(a: Column, b: Column) -> Column:
    """Mean distance of corresponding joints."""
    return F.aggregate(F.zip_with(a, b, g.distance), F.lit(0.0), lambda s, d: s + d) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def farthest(poses: DataFrame, k: int, start: DataFrame | None = None) -> DataFrame:
    """pose_id, rank of k poses, each the farthest from those before it (ties: smallest id).

    One pass over the poses per pick; only the picked pose goes through the driver.  The
    running distances are checkpointed every 8 picks.  start: (pose_id, rank) picked earlier,
    to go on from.
    """
    spark = poses.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    picked = [r.pose_id for r in start.orderBy("rank").collect()] if start is not None else []
    if not picked:
        first = poses.agg(F.min("pose_id")).first()[0]
        picked = [] if first is None else [first]
    d = poses.select("pose_id", "joints", F.lit(float("inf")).alias("dist"))

    def closer(d: DataFrame, pose: int) -> DataFrame:
        joints = poses.where(F.col("pose_id") == pose).select("joints").first()["joints"]
        own = F.expr("array(" + ", ".join(f"named_struct('x', {j.x!r}D, 'y', {j.y!r}D, 'z', {j.z!r}D)" for j in joints) + ")")
        return d.select("pose_id", "joints", F.least("dist", mpje(F.col("joints"), own)).alias("dist"))

    for n in picked:
        d = closer(d, n)
    while picked and len(picked) < k:
        if len(picked) % 8 == 0:
            d = d.checkpoint()
        best = d.where(~F.col("pose_id").isin(picked)).agg(F.max(F.struct("dist", (-F.col("pose_id")).alias("neg"))).alias("m")).first()["m"]
        if best is None:
            break
        picked.append(-best["neg"])
        d = closer(d, picked[-1])
    return spark.createDataFrame([(p, i) for i, p in enumerate(picked[:k])], "pose_id long, rank int")


def in_sequence(frames: DataFrame, within: float = 0.5) -> DataFrame:
    """frames (frame_id, sequence, frame, t) -> pairs a, b of one sequence, b later than a by less than `within` seconds, with the frame difference.

    Times are cut into slots of `within` seconds, so a frame meets only its own slot and the next.
    """
    slot = F.floor(F.col("t") / within).cast("long")
    a = frames.select(F.col("frame_id").alias("a"), "sequence", F.col("frame").alias("fa"), F.col("t").alias("ta"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    b = frames.select(F.col("frame_id").alias("b"), "sequence", F.col("frame").alias("fb"), F.col("t").alias("tb"), slot.alias("slot"))
    j = a.join(b, ["sequence", "slot"]).where((F.col("fb") > F.col("fa")) & (F.abs(F.col("tb") - F.col("ta")) < within))
    return j.select("a", "b", (F.col("fb") - F.col("fa")).alias("frame_diff"))


def similar(features: DataFrame, k: int = 100, low: float = 0.7, high: float = 0.9, apart: str | None = None, rows: int | None = None) -> DataFrame:
    """features (id, v of unit length) -> b, a, similarity, rank: of the k rows most similar to each b, all rows looked at, those inside (low, high).

    apart: only rows that differ in this column (as of other sequences) are looked at.
    """
    return blocks.most_similar(features, k, apart, rows).where((F.col("similarity") > low) & (F.col("similarity") < high))


def code_difference(facts: DataFrame, pairs: DataFrame, more_than: int) -> DataFrame:
    """facts (pose_id, code_id, intptt_id), pairs (a, b) -> a, b, n_diff above the threshold."""
    fa = pairs.join(facts.select(F.col("pose_id").alias("a"), "code_id", F.col("intptt_id").alias("ia")), "a")
    fb = facts.select(F.col("pose_id").alias("b"), "code_id", F.col("intptt_id").alias("ib"))
    d = fa.join(fb, ["b", "code_id"]).groupBy("a", "b").agg(F.sum((F.col("ia") != F.col("ib")).cast("int")).alias("n_diff"))
    return d.where(F.col("n_diff") > more_than)


def window_keep(pairs: DataFrame, window: int = 3, keep: int = 3, seed: int = 0) -> DataFrame:
    """pairs (a, b, similarity) -> of each b the `keep` drawn from its `window` most similar a; short: whether it has fewer."""
    top = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("similarity"), "a"))).where(F.col("rank") <= window)
    d = top.withColumn("draw", F.row_number().over(Window.partitionBy("b").orderBy(uniform(seed, "window", F.col("a"), F.col("b")), "a")))
    n = F.count("*").over(Window.partitionBy("b"))
    return d.withColumn("short", n < keep).where(F.col("draw") <= keep).select("a", "b", "rank", "short")


def role_unicity(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, frame_diff) -> each pose at most once as b, then at most once as a; the smallest frame difference stays."""
    once = lambda df, who, other: df.withColumn("r", F.row_number().over(Window.partitionBy(who).orderBy("frame_diff", other))).where("r = 1").drop("r")
    return once(once(pairs, "b", "a"), "a", "b")


def in_order(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of one sequence -> the same with place: by b and then a."""
    return text.in_order(pairs.select("a", "b").distinct(), "b", "a")


def annotation_order(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """pairs (a, b) of different sequences, a to be changed into b -> b, a, two_way, step, place.

    Poses b are gone through by id.  Each takes one a, and where it can one that is a later b itself and
    not yet taken: then the pair is asked both ways (step 0 and 1) and a isn't gone through any more.  Among
    what it can take, b prefers an a the more, the fewer b it can be used for: each pair draws a
    waiting time that grows with those uses, and the shortest is taken.

    What a b takes follows from what those before it took.  So all b choose at once, given what the round before
    gave, until no choice changes.  Choices before the first that changed are those of going through them one by one,
    and leave the rounds with all they rule out; the smallest b left is always among them.
    """
    p = pairs.select("a", "b").where("a <> b").distinct()
    uses = p.groupBy("a").agg(F.count("*").alias("uses"))
    wait = -F.log(1 - uniform(seed, "annotate", F.col("b"), F.col("a"))) * F.col("uses")
    p = stored(p.join(uses, "a").select("a", "b", wait.alias("wait")), "choices")
    later = p.select(F.col("b").alias("a")).distinct()
    open_ = stored(p.where("a > b").join(later, "a", "left_semi"), "open")  # what b can take both ways
    guess = done = open_.select("a", "b").where("false")
    while True:
        by = guess.select("a", F.col("b").alias("by"))
        there = open_.join(by, "a", "left").where("by is null or by >= b").join(guess.select(F.col("a").alias("b")), "b", "left_anti")
        first = there.groupBy("b").agg(F.min(F.struct("wait", "a")).alias("x")).select("b", F.col("x.a").alias("a"))
        took = stored(first.groupBy("a").agg(F.min("b").alias("b")), "taken")
        changed = took.join(by, "a", "full").where(~F.col("b").eqNullSafe(F.col("by"))).agg(F.min(F.least("b", "by"))).first()[0]
        if changed is None:
            done = done.unionByName(took)
            break
        settled, guess = took.where(F.col("b") < changed), took.where(F.col("b") >= changed)
        done = done.unionByName(settled)
        left = open_.where(F.col("b") >= changed).join(settled.select("a"), "a", "left_anti").join(settled.select(F.col("a").alias("b")), "b", "left_anti")
        open_ = stored(left, "open")
    alone = p.join(done.select("b"), "b", "left_anti").join(done.select(F.col("a").alias("b")), "b", "left_anti")
    alone = alone.groupBy("b").agg(F.min(F.struct("wait", "a")).alias("x")).select("b", F.col("x.a").alias("a"), F.lit(False).alias("two_way"), F.array(F.lit(0)).alias("steps"))
    both = done.select("b", "a", F.lit(True).alias("two_way"), F.array(F.lit(0), F.lit(1)).alias("steps"))
    out = alone.unionByName(both).select("b", "a", "two_way", F.explode("steps").alias("step"))
    out = text.in_order(out, "b", "step")
    turned = F.col("step") == 1
    return out.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), "two_way", "step", "place")


def nearest(features: DataFrame, query: DataFrame, n: int = 12) -> DataFrame:
    """The n rows of features most similar to one query vector."""
    s = features.crossJoin(F.broadcast(query.select(F.col("v").alias("q")).limit(1))).select("id", F.round(dot(F.col("v"), F.col("q")), 9).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "id").limit(n)
