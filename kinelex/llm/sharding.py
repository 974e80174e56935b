"""Two-pass external shuffle into shards (DataFrame functions only).

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash of all their
columns, and of a number of their own where equal records would fill a bucket; pass two Fisher-Yates-shuffles each bucket (Spark's `shuffle`) and lays the buckets end
to end.  Position p of that order goes to shard p mod n: the `rows` law, counts at most one
apart.  The records themselves move once, in the scatter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHOLE, packed, stored

#: Equal records are laid out again in blocks of so many.
BLOCK = 1000
#: Bucket sizes are summed in runs of so many buckets, and the runs' sums in one small window.
RUN = 4096
#: Buckets of the smallest tables.
LEAST = 256


def _parts(df: DataFrame, of: str = "") -> list[Column]:
    """The columns of a row (or of its packed form `of`) as values that can be hashed and compared: what holds a map or a variant as its JSON text."""
    return [F.to_json(F.struct(x)) if "map<" in t or "variant" in t else x for c, t in df.dtypes for x in [F.col(f"{of}`{c}`")]]


def _spread(rows: DataFrame, parts: list[Column], most_bytes: int) -> DataFrame:
    """whole, size and h of records -> whole, h and copy: 0, or a gapless number over equal records where those exceed `most_bytes` together.

    Such records are counted and laid out again from the count, block by block, so neither a
    task nor an order of rows decides about them.
    """
    many = rows.groupBy("h").agg(F.sum("size").alias("n"), F.count("*").alias("c")).where((F.col("n") > most_bytes) & (F.col("c") > 1)).select("h")
    many = stored(many, "repeated")
    if many.isEmpty():
        return rows.select("h", WHOLE, F.lit(0).cast("long").alias("copy"))
    alone = rows.join(many, "h", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    again = rows.join(many, "h", "left_semi").groupBy("h", *parts).agg(F.any_value(WHOLE).alias(WHOLE), F.count("*").alias("c"))
    blocks = again.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / BLOCK))).alias("block")).repartition("h", "block")
    first = F.col("block") * BLOCK
    copies = blocks.select("h", WHOLE, F.explode(F.sequence(first, F.least(first + BLOCK, F.col("c")) - 1)).alias("copy"))
    return alone.select("h", WHOLE, "copy").unionByName(copies)


def shuffled(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 7, bucket_bytes: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """df plus shard int (0 to shards-1) and slot long (gapless from 0 within a shard).

    Columns of df named shard or slot are replaced, all others come back as they are, maps included;
    null keys hash like any value; null and empty texts are records as others; repeated rows each
    get a place of their own, and no key, null or repeated record fixes a bucket.  An empty
    table gives an empty result.  The order is a function of rows, seed and table size alone: the
    numbers of buckets and of tasks follow from the size, and a bucket's rows are sorted by seeded
    hashes before they are shuffled, so reruns, recomputed tasks and other partition settings agree.
    """
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")))
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
    total = df.agg(F.sum(size)).first()[0] or 0
    n = max(LEAST, math.ceil(total / bucket_bytes))
    tasks = max(LEAST // 4, math.ceil(total / task_bytes))  # not a setting: Spark's `shuffle` draws by partition
    rows = df.select(packed(df), size.alias("size"), F.xxhash64(*_parts(df)).alias("h"))
    rows = _spread(rows, _parts(df, f"{WHOLE}."), bucket_bytes // 8)
    place = lambda more: F.xxhash64(F.lit(seed + more), "h", "copy")
    bucket = F.pmod(place(0), F.lit(n)).alias("bucket")
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    counts = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.orderBy("run")).alias("first"))
    inside = counts.select("run", "bucket", before(Window.partitionBy("run").orderBy("bucket")).alias("inside"))
    starts = inside.join(runs, "run").select(F.col("bucket").alias("b"), (F.col("first") + F.col("inside")).alias("start"))
    record = F.struct(place(1).alias("order"), F.col("h"), F.col("copy"), F.col(WHOLE))
    pile = rows.select(bucket, record.alias("r")).repartition(tasks, "bucket").groupBy("bucket").agg(_sorted(F.collect_list("r")).alias("rows"))
    pile = pile.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    laid = pile.join(starts, F.col("bucket") == F.col("b")).select("start", F.posexplode("rows").alias("at", "r"))
    spot = F.col("start") + F.col("at")
    return laid.select(*(F.col(f"r.{WHOLE}.`{c}`").alias(c) for c in df.columns), (spot % shards).cast("int").alias("shard"), F.floor(spot / shards).cast("long").alias("slot"))


def _sorted(records: Column) -> Column:
    """Records in the order of their hashes; what they hold need not be comparable."""
    key = lambda r: F.struct(r["order"], r["h"], r["copy"])
    return F.array_sort(records, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def write(df: DataFrame, path: str, **options) -> None:
    """The shuffled records as Parquet, a folder per shard, each file sorted by slot."""
    out = shuffled(df, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
