"""Assembly of pose-text datasets: splits, captions, triplets, mixtures, interval labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_of(data_id: Column) -> Column:
    """train for eight of ten ids, val and test for one each."""
    return F.when(F.pmod(data_id, F.lit(10)) < 8, "train").when(F.pmod(data_id, F.lit(10)) == 8, "val").otherwise("test")


def captions(sources: list[DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """sources (data_id, caption_idx, text), in file order -> data_id, texts: those of the first source first.

    ids: only these data_ids; None: all that have a text.  Ids without a text don't appear.
    """
    rows = None
    for n, s in enumerate(sources):
        part = s.select("data_id", F.lit(n).alias("file"), "caption_idx", "text")
        rows = part if rows is None else rows.unionByName(part)
    if ids is not None:
        rows = rows.join(ids.select("data_id").distinct(), "data_id", "left_semi")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("file", "caption_idx", "text"))), lambda x: x["text"])
    return rows.where("text is not null").groupBy("data_id").agg(texts.alias("texts"))


def choose(items: DataFrame, how: int | str, seed: int = 0) -> DataFrame:
    """One text of each item: a fixed index (an error beyond the end), 'index' (by id) or 'random' (by keyed hash)."""
    from ..functions.exprs import uniform

    n = F.size("texts")
    if how == "index":
        at = F.pmod("data_id", n)
    elif how == "random":
        at = F.floor(uniform(seed, "caption", F.col("data_id")) * n)
    else:
        at = F.when(F.lit(how) < n, F.lit(how)).otherwise(F.raise_error(F.concat(F.lit("no text "), F.lit(str(how)), F.lit(" for "), F.col("data_id").cast("string"))))
    return items.select("data_id", F.element_at("texts", at.cast("int") + 1).alias("text"))


def triplets(pair_map: DataFrame, info: DataFrame, texts: DataFrame) -> DataFrame:
    """pair_map (pair_id, pose_a, pose_b), info (pose_id, sequence), texts (data_id, texts) -> the pairs with a text, and whether both poses are of one sequence."""
    a, b = (info.select(F.col("pose_id").alias(f"pose_{x}"), F.col("sequence").alias(f"seq_{x}")) for x in "ab")
    out = pair_map.join(texts.withColumnRenamed("data_id", "pair_id"), "pair_id").join(a, "pose_a").join(b, "pose_b")
    return out.select("pair_id", "pose_a", "pose_b", (F.col("seq_a") == F.col("seq_b")).alias("in_sequence"), "texts")


def mixed(pairs: DataFrame, singles: DataFrame, rest_pose: int = -1) -> DataFrame:
    """Pairs and single poses in one set: ids get a prefix, a missing pose A is the rest pose."""
    p = pairs.select(F.concat(F.lit("pair_"), F.col("pair_id").cast("string")).alias("data_id"), "pose_a", "pose_b", F.size("texts").alias("n_texts"))
    s = singles.select(F.concat(F.lit("pose_"), F.col("data_id").cast("string")).alias("data_id"), F.col("data_id").alias("pose_b"), F.size("texts").alias("n_texts"))
    return p.unionByName(s, allowMissingColumns=True).withColumn("pose_a", F.coalesce("pose_a", F.lit(rest_pose).cast("long")))


def interval_labels(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """frames (frame_id, sequence, t), spans (sequence, start_t, end_t, label) -> every label whose span, ends included, holds the frame's time.

    Time is cut into slots as wide as the spans are on average, so a span lies in about two of them and a frame
    meets the spans of its own slot alone; a long sequence is many groups.  Spans that end before they start hold nothing.
    """
    spans = spans.where("start_t <= end_t")
    width = spans.agg(F.avg(F.col("end_t") - F.col("start_t"))).first()[0] or 1.0
    slot = lambda t: F.floor(F.col(t) / F.lit(float(width))).cast("long")
    laid = spans.select("sequence", "start_t", "end_t", "label", F.explode(F.sequence(slot("start_t"), slot("end_t"))).alias("slot"))
    at = frames.select("frame_id", "sequence", "t", slot("t").alias("slot"))
    return at.join(laid, ["sequence", "slot"]).where("t >= start_t and t <= end_t").select("frame_id", "sequence", "label")


def label_histogram(labels: DataFrame, frames: DataFrame, sequences: DataFrame) -> DataFrame:
    """labels (frame_id, label), frames (frame_id, sequence), sequences (sequence, marker) -> bucket, frames.

    A frame of a sequence that isn't listed counts as `none`, one of a sequence that only has a marker
    under that marker; others by their labels: `0 labels`, `null label` (some label is null),
    `1 label` or `>1 labels`.
    """
    n = labels.groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("nulls"))
    f = frames.select("frame_id", "sequence").join(sequences.select("sequence", "marker", F.lit(True).alias("listed")), "sequence", "left").join(n, "frame_id", "left")
    bucket = (
        F.when(F.col("listed").isNull(), "none").when(F.col("marker").isNotNull(), F.col("marker"))
        .when(F.coalesce("n", F.lit(0)) == 0, "0 labels").when(F.col("nulls") > 0, "null label").when(F.col("n") == 1, "1 label").otherwise(">1 labels")
    )
    return f.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("frames"))


def control_subset(references: DataFrame, automatic: DataFrame) -> DataFrame:
    """references (data_id, texts), automatic (data_id, text) -> the reference items with the automatic text put first."""
    return references.join(automatic, "data_id").select("data_id", F.concat(F.array("text"), "texts").alias("texts"))


def pose_scan(split_ids: DataFrame, poses: DataFrame) -> DataFrame:
    """The poses of a split, with or without a text: split_ids (data_id), poses (pose_id, ...) -> the rows of poses."""
    return poses.join(split_ids.select(F.col("data_id").alias("pose_id")).distinct(), "pose_id", "left_semi")


def lookup(split_ids: DataFrame, items: DataFrame) -> DataFrame:
    """split_ids (data_id), items (data_id, texts) -> number, data_id, text: the place in the split, counted from 0, and the first text or nothing."""
    from .text import in_order

    placed = in_order(split_ids.select("data_id").distinct(), "data_id")
    first = items.select("data_id", F.get("texts", F.lit(0)).alias("first"))
    return placed.join(first, "data_id", "left").select(F.col("place").alias("number"), "data_id", F.coalesce("first", F.lit("")).alias("text"))


def with_texts(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """rows with the texts of another source (data_id, texts) in place of their own; rows without one go."""
    return rows.drop("texts").join(texts.select(F.col("data_id").alias(key), "texts"), key)


def first_items(items: DataFrame, n: int, *by: str) -> DataFrame:
    """The first n items in the order of `by`."""
    return items.orderBy(*by).limit(n)


def distinct_in_order(rows: DataFrame, key: str, value: str, *by: str) -> DataFrame:
    """key, values: the distinct values of each key in the order they are first seen by `by`."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*by)).alias("at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))
