"""JSON maps and other files of the domain as tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship


def values_of(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with a JSON map in `column` -> the other columns, key, value: a row per entry."""
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.explode(F.from_json(column, schema)).alias("key", "value"))


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file holding one JSON object -> key, value (of SQL type `value`)."""
    return values_of(spark.read.text(path, wholetext=True), "value", f"map<string,{value}>")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map from ids to a text or a list of texts -> data_id, caption_idx, text."""
    raw = read_json_map(spark, path, "string")
    lists = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return raw.select(F.col("key").cast("long").alias("data_id"), F.posexplode(lists).alias("caption_idx", "text"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """Folder of .npz sequences (poses: frames by 3 J numbers, mocap_framerate) -> path, frame, fps, rotvecs; each file is opened once."""
    ship(spark)

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    poses, fps = z["poses"], float(z["mocap_framerate"])
                for at in range(0, len(poses), 1024):
                    part = poses[at : at + 1024].astype(float)
                    yield pd.DataFrame({"path": name, "frame": range(at, at + len(part)), "fps": fps, "rotvecs": [r.reshape(-1, 3).tolist() for r in part]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(frames, "path string, frame int, fps double, rotvecs array<array<double>>")


def stage(df_or_none: DataFrame | None, spark: SparkSession, path: str) -> DataFrame:
    """A stage's table: written once, read afterwards; an existing one is not computed again."""
    if df_or_none is not None:
        df_or_none.write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
