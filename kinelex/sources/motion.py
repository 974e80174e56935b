"""Poses read from motion sequences: only the frames asked for, with their orientation normalised."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.exprs import let
from ..functions.shipping import ship

_POINT = "struct<x:double,y:double,z:double>"
_ARROW = pa.schema([("pose_id", pa.int64()), ("sequence", pa.string()), ("frame", pa.int64()), ("fps", pa.float64()), ("rotvecs", pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"]))), ("n_read", pa.int64())])


def rows_of(npz: bytes, member: str, rows: list[int]) -> tuple[list[np.ndarray | None], int]:
    """Rows of an array inside an .npz file, None for one it lacks, and how many rows were decoded; no other row is."""
    with zipfile.ZipFile(io.BytesIO(npz)) as z, z.open(f"{member}.npy") as f:
        version = np.lib.format.read_magic(f)
        shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        start, width = f.tell(), dtype.itemsize * int(np.prod(shape[1:]))
        if by_columns:
            whole = np.frombuffer(f.read(), dtype).reshape(shape[::-1]).T
            return [whole[r].astype(float) if 0 <= r < shape[0] else None for r in rows], shape[0]
        found: dict[int, np.ndarray] = {}
        for r in sorted({r for r in rows if 0 <= r < shape[0]}):
            f.seek(start + r * width)
            found[r] = np.frombuffer(f.read(width), dtype).reshape(shape[1:]).astype(float)
    return [found.get(r) for r in rows], len(found)


def read_frames(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (pose_id, sequence, frame) -> the same, fps, rotvecs (an array of x, y, z per joint), n_read.

    path: a folder of .npz sequences (poses: frames by 3 J numbers; mocap_framerate), named by `sequence` as
    their place below it.  A sequence is one row of bytes wherever Spark can read them; it meets the frames
    that are asked of it, and n_read says how many distinct frames of it were decoded for this.  A frame that a
    sequence lacks, or whose sequence is missing, has null rotvecs; frames asked twice come twice.
    """
    ship(spark)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content, asked in zip(*(b.column(i) for i in range(3)), strict=True):
                asked, name = asked.as_py(), name.as_py()
                frames = [x["frame"] for x in asked]
                rows, n, fps = [None] * len(asked), 0, None
                if content.is_valid:
                    raw = content.as_py()
                    rows, n = rows_of(raw, "poses", [-1 if f is None else f for f in frames])
                    with np.load(io.BytesIO(raw)) as z:
                        fps = float(z["mocap_framerate"])
                points = [None if r is None else [dict(zip("xyz", p, strict=True)) for p in r.reshape(-1, 3).tolist()] for r in rows]
                yield pa.RecordBatch.from_pydict({"pose_id": [x["pose_id"] for x in asked], "sequence": [name] * len(asked), "frame": frames, "fps": [fps] * len(asked), "rotvecs": points, "n_read": [n] * len(asked)}, _ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    files = files.select(F.regexp_replace(F.substring_index("path", f"{root}/", -1), r"\.npz$", "").alias("sequence"), "content")
    asked = wanted.groupBy("sequence").agg(F.collect_list(F.struct(F.col("pose_id").cast("long").alias("pose_id"), F.col("frame").cast("long").alias("frame"))).alias("asked"))
    both = asked.join(files, "sequence", "left").select("sequence", "content", "asked")
    return both.mapInArrow(decoded, f"pose_id long, sequence string, frame long, fps double, rotvecs array<{_POINT}>, n_read long")


def normalized(rotvecs: Column, applied: Column | None = None) -> Column:
    """A struct of the pose with its root turned, and of the turn itself as a rotation vector.

    The root's Euler angle about z is set to zero; or, with `applied` (a rotation vector), that turn is applied
    instead, as for a second pose that shall keep its place to the first.
    """

    def turned(root: Column) -> Column:
        q = g.quaternion(root)
        new = g.without_heading(root) if applied is None else g.multiply(g.quaternion(applied), q)
        return let(new, lambda n: F.struct(g.rotation_vector(n).alias("root"), g.rotation_vector(g.multiply(n, g.inverse(q))).alias("turn")))

    rest = F.slice(rotvecs, F.lit(2), F.greatest(F.size(rotvecs) - 1, F.lit(0)))
    return let(F.get(rotvecs, F.lit(0)), lambda root: let(turned(root), lambda t: F.struct(F.concat(F.array(t["root"]), rest).alias("rotvecs"), t["turn"].alias("turn"))))
