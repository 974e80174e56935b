"""Results written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a stored table that may be broadcast unasked.
FEW = 10_000
#: Frees the shuffle files of a query as it ends.  Else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Unset: a temporary one on a local master, an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinelex-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, path: str) -> DataFrame:
    """`df` written once as Parquet and read again, with its rows counted on the way; what it shuffled is freed.

    Spark would broadcast a table whose files are small, and columns of repeated values, or rows yet to be
    exploded, take a hundredth of their size in memory.  So a table of more than FEW rows asks for merge
    joins; the request holds through projections and aggregates up to the next join, and F.broadcast overrides it.
    """
    seen, conf = Observation(), df.sparkSession.conf
    before = conf.get(FREED, "false")
    conf.set(FREED, "true")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    finally:
        conf.set(FREED, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.hint("merge") if seen.get["n"] > FEW else table


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written once in the shared folder and read again: what follows is planned by itself, and a lost executor costs a re-read."""
    return written(df, f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}")
