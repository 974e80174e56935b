"""Tables that are made once for the same inputs and parameters, and read afterwards."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import shared_dir


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's content: schema, number of rows, and sums over hashes of its rows, whatever their order and partitions."""
    columns = [F.to_json(F.struct(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    h = F.xxhash64(*columns)
    found = df.select(h.alias("h"), F.xxhash64(F.lit(1), *columns).alias("g")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("g")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{'|'.join(map(str, found))}".encode()).hexdigest()


class Cache:
    """Tables below a folder, each with a manifest that says what it was made from.

    A manifest is written after its table and renamed into place, so a table whose making was broken off has
    none and is never read.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = (root or f"{shared_dir(spark).rstrip('/')}/cache").rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifests(self, name: str) -> list[dict]:
        """What is there under a name, the newest first."""
        fs, at = self._at(f"{self.root}/{name}")
        if not fs.exists(at):
            return []
        if not (found := [s for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")]):
            return []
        found.sort(key=lambda s: (-s.getModificationTime(), s.getPath().getName()))
        texts = {r.path.rsplit("/", 1)[1]: r.value for r in self.spark.read.text([s.getPath().toString() for s in found], wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()}
        return [json.loads(texts[s.getPath().getName()]) for s in found]

    def get(self, name: str, inputs: dict[str, DataFrame], params: dict, build: Callable[[], DataFrame]) -> DataFrame:
        """The table made from these inputs and parameters: read if it is there, else built and written.

        A parameter that is None stands for any value: the newest table that agrees in all others is read, and
        only if there is none it is built with None.
        """
        content = {k: fingerprint(df) for k, df in sorted(inputs.items())}
        for m in self.manifests(name):
            if m["inputs"] == content and m["params"].keys() == params.keys() and all(v is None or m["params"][k] == v for k, v in params.items()):
                return self.spark.read.parquet(m["path"])
        path = f"{self.root}/{name}/table-{uuid.uuid4().hex}"
        build().write.parquet(path)
        text = json.dumps({"inputs": content, "params": params, "path": path})
        part, done = f"{path}.part", f"{path}.json"
        fs, at = self._at(part)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(at, self._at(done)[1])
        return self.spark.read.parquet(path)
