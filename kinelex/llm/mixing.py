"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key.  Within its source the keys are cut into equal
ranges (a range partition, as the keys are uniform), each range is sorted, and word
counts are summed in three levels: inside each range, over the ranges of a run, and over the runs.  The cut lies where that distributed prefix sum reaches the source's
budget; a budget above the source's size first takes whole epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WHOLE, fields, n_words, numbered, scratch, stored, unpacked

#: 2 ** 52: keys are the first 13 hexadecimal digits of an md5 digest.
KEY_SPACE = 1 << 52
#: Ranges are summed in runs of so many.
RUN = 4096


def hash_key(seed: str, *parts: Column) -> Column:
    """A uniform 52-bit integer from the parts; nulls count as an empty string."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """sizes: one row per source (source, n_docs, source_size) -> the same with `target`.

    Sources by code point, null last, weigh 1, 2, 3 in turn.  They share the sum of all
    sizes by weight; no target exceeds `most` times its source's size, and what is over
    goes to the others by weight until none is above.  That level is found in closed form:
    in the order of (cap / weight) the first k sources stand at their caps.  The table has
    a row per source, so its two windows are small however large the documents are.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("__w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    w = w.withColumn("__cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (
        w.withColumn("__all", F.sum("source_size").over(everything))
        .withColumn("__weights", F.sum("__w").over(everything))
        .withColumn("__cap_before", F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__w_before", F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__left", (F.col("__all") - F.col("__cap_before")).cast("double"))
        .withColumn("__rest", (F.col("__weights") - F.col("__w_before")).cast("double"))
        # at its cap while the level that all the rest would share is not below cap / weight
        .withColumn("__at_cap", F.col("__left") * F.col("__w") >= F.col("__cap") * F.col("__rest"))
        .withColumn("__first", F.min(F.when(~F.col("__at_cap"), F.struct("__cap_before", "__w_before"))).over(everything))
        .withColumn("__level_left", (F.col("__all") - F.col("__first.__cap_before")).cast("double"))
        .withColumn("__level_rest", (F.col("__weights") - F.col("__first.__w_before")).cast("double"))
    )
    target = F.when(F.col("__at_cap"), F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__level_left") / F.col("__level_rest"))
    return w.select("source", "n_docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def plan(docs: DataFrame, most: int = 3, seed: str = "mix", range_docs: int = 1000) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source, source_size, target, copies, taken, and ROW where docs is numbered.

    A document is taken `copies` times: once per whole epoch of its source, and once more if
    it lies before the cut.  The document on the cut is taken if that brings the source
    nearer to its target, so a source misses it by at most half a document.  Null text: size 0;
    null source: a source of its own; empty table: empty result; other columns are not read.  Keys
    come from doc_id and text, so rows that share a doc_id (or have none) spread over the ranges
    like any others; rows equal in both are ordered by size and take what is left in turn, so
    repeated rows and reruns give the same rows.
    """
    # Words are counted once; what follows reads the narrow table of sizes.
    row = [ROW] if ROW in docs.columns else []
    key = hash_key(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    d = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("__key"), *row), "sizes")
    sizes = d.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    goal = targets(sizes, most).withColumn("__ranges", F.ceil(F.col("n_docs") / range_docs).cast("long"))
    # The large side is never shuffled by source alone: after this join it goes by (source, range).
    d = d.join(goal.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    d = d.withColumn("__range", F.floor(F.col("__key").cast("double") / KEY_SPACE * F.col("__ranges")).cast("long"))
    # ranges are summed in runs of RUN, and the runs' sums in a window with a row per run
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "__range").agg(F.sum("size").alias("__sum")).withColumn("__run", F.floor(F.col("__range") / RUN))
    runs = sums.groupBy("source", "__run").agg(F.sum("__sum").alias("__sum"))
    runs = runs.select(F.col("source").alias("__s"), F.col("__run").alias("__r"), F.coalesce(F.sum("__sum").over(before("source", "__run")), F.lit(0)).alias("__first"))
    sums = sums.withColumn("__inside", F.coalesce(F.sum("__sum").over(before("source", "__run", "__range")), F.lit(0)))
    starts = sums.join(runs, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__run") == F.col("__r")))
    starts = starts.select(F.col("source").alias("__s"), F.col("__range").alias("__r"), (F.col("__first") + F.col("__inside")).alias("__start"))
    inside = Window.partitionBy("source", "__range").orderBy("__key", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("__before", F.col("__start") + F.col("__within")).withColumn("__epochs", epochs)
    left = F.col("target") - F.col("__epochs") * F.col("source_size")
    once_more = F.col("__before") + F.col("size") / F.lit(2.0) < left
    d = d.withColumn("copies", F.col("__epochs") + once_more.cast("long"))
    return d.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *row)


def mix(docs: DataFrame, most: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the rows of `docs`, each as often as the mix takes it.

    A document of a source below its target is repeated by the source's epochs; one behind
    the cut goes.  Columns of `docs` stay as they are; nulls, ties and repeated rows are taken as in
    `plan`; an empty table gives an empty result.
    """
    rows = numbered(docs)
    with scratch(docs.sparkSession) as kept:
        taken = kept(plan(fields(rows, "doc_id", "text", "source"), most, seed).where("copies > 0").select(ROW, "copies"), "copies")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch")
    return unpacked(rows.join(taken, ROW).select(WHOLE, again))
