"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import written

#: ASCII white space, as the word pattern below sees it.
SPACES = " \t\n\x0b\f\r"
#: A word: a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null and for blank texts."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def without(text: Column, chars: str) -> Column:
    """The text without any of some ASCII characters."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Unset: a temporary one on a local master, an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinelex-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


#: Folders that go when the innermost `scratch` ends.
_passing: list[list[str]] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again.

    Used where a result feeds several later jobs: a lost executor costs a re-read,
    never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    return written(df, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is stored inside goes at the end; the function given stores what stays.

    Only for work whose results are all stored by that function: a plan that still reads what went would fail.
    """
    _passing.append([])

    def kept(df: DataFrame, what: str) -> DataFrame:
        held, _passing[:] = _passing[:], []
        try:
            return stored(df, what)
        finally:
            _passing[:] = held

    try:
        yield kept
    finally:
        for path in _passing.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of a filter of row numbers for each number in it, and at most: 2 ** 27 bits are 2 million longs.
BITS, MOST_BITS = 16, 1 << 27


def perhaps_in(rows: DataFrame, ids: DataFrame, column: str = "row") -> DataFrame:
    """rows plus `perhaps`: false only where the number is not among ids (all of one column, whole numbers).

    The numbers are marked in a map of bits whose size is bounded however many there are, so it may be
    broadcast; what it lets pass is still to be joined.  It keeps most rows from being shuffled where few are wanted.
    """
    n = ids.count()
    bits = 1 << max(10, min(MOST_BITS, max(1, n * BITS) - 1).bit_length())
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    marks = ids.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("marks"))
    out = rows.withColumns({"word": word, "mask": mask}).join(F.broadcast(marks), "word", "left")
    return out.withColumn("perhaps", F.coalesce(F.col("marks").bitwiseAND(F.col("mask")) != 0, F.lit(False))).select(*rows.columns, "perhaps")


def only(rows: DataFrame, ids: DataFrame, column: str = "row") -> DataFrame:
    """The rows whose number is among ids; rows that can't be are never shuffled."""
    return perhaps_in(rows, ids, column).where("perhaps").drop("perhaps").join(ids, column, "left_semi")


def without_rows(rows: DataFrame, ids: DataFrame, column: str = "row") -> DataFrame:
    """The rows whose number is not among ids; only those that may be are shuffled."""
    known = perhaps_in(rows, ids, column)
    return known.where("not perhaps").drop("perhaps").unionByName(known.where("perhaps").drop("perhaps").join(ids, column, "left_anti"))


#: The column that tells the rows of a numbered table apart, and the one that holds a row as it came.
ROW, WHOLE = "row", "whole"


def packed(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that no name of theirs meets a helper's."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(WHOLE)


def unpacked(df: DataFrame) -> DataFrame:
    """The rows of a table of packed ones, as they came."""
    return df.select(*(F.col(f"{WHOLE}.`{c}`").alias(c) for c in df.schema[WHOLE].dataType.names))


def numbered(df: DataFrame) -> DataFrame:
    """row, whole: `df` stored with a number of its own for each row, so that repeated rows and null ids can be told apart."""
    return stored(df.select(F.monotonically_increasing_id().alias(ROW), packed(df)), "rows")


def fields(rows: DataFrame, *names: str) -> DataFrame:
    """The number of each numbered row and some of the columns it came with; others are not read."""
    return rows.select(ROW, *(F.col(f"{WHOLE}.`{n}`").alias(n) for n in names))


def surplus(rows: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of numbered rows and their members (row, component) the numbers of all but the one row per component with the smallest key, null keys last."""
    order = fields(rows, key, text).select(ROW, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("text"), F.col(ROW).alias(ROW)).alias("x"))
    kept = members.join(order, ROW).groupBy("component").agg(F.min("x").alias("x")).select(F.col(f"x.{ROW}").alias(ROW))
    return members.select(ROW).join(kept, ROW, "left_anti")
