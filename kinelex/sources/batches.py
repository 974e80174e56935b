"""Rows in the shuffled batches of an epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.text import in_order


def drawn(seed: int, epoch: int, *keys: str) -> Column:
    """A row's place in an epoch's order, as a text that sorts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys)))


def batches(rows: DataFrame, keys: list[str], size: int, epoch: int = 0, seed: int = 0, drop_last: bool = False, start: int = 0) -> DataFrame:
    """rows plus batch and slot: every row once an epoch, in batches of `size`, the last one shorter or left out.

    The order follows from seed, epoch and the keys alone, which should tell rows apart (rows that don't differ in
    them are ordered by a hash of the whole row): it is sorted by ranges, so partitions and reruns make no difference
    and nothing gathers in one task.  start: the first batch wanted, to go on where a run was broken off.
    """
    named = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("whole"), drawn(seed, epoch, *keys).alias("draw"), F.xxhash64(*(F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t)).alias("tie"))
    placed = in_order(named, "draw", "tie")
    out = placed.select("whole", F.floor(F.col("place") / size).cast("long").alias("batch"), (F.col("place") % size).cast("int").alias("slot"))
    if drop_last:
        out = out.where(F.col("batch") < rows.count() // size)
    return out.where(F.col("batch") >= start).select(*(F.col(f"whole.`{c}`").alias(c) for c in rows.columns if c not in ("batch", "slot")), "batch", "slot")


def collated(batched: DataFrame, *columns: str) -> DataFrame:
    """batch, n, and each column as an array in the order of the slots: a row per batch, of bounded size."""
    rows = F.sort_array(F.collect_list(F.struct("slot", *columns)))
    out = batched.groupBy("batch").agg(rows.alias("rows"))
    return out.select("batch", F.size("rows").alias("n"), *(F.transform("rows", _field(c)).alias(c) for c in columns))


def _field(name: str):
    return lambda r: r[name]
