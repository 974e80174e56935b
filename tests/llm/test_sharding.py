"""No key and no repeated record fixes a bucket of the shuffle."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF_DIR, spark_rows
from kinelex.llm import queries, sharding
from kinelex.llm.common import packed


def test_repeated_records_and_keys_spread(spark):
    text = "x" * 400
    rows = [(None, text)] * 6000 + [(5, f"{i} {text}") for i in range(6000)] + [(i, f"{i} {text}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = df.select(packed(df), (F.octet_length("text") + 64).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    spread = sharding._spread(whole, sharding._parts(df, "whole."), (64 << 10) // 8)
    assert Counter((r.doc_id, r.text) for r in spread.select("whole.*").collect()) == Counter(rows)
    buckets = spread.groupBy(F.pmod(F.xxhash64(F.lit(7), "h", "copy"), F.lit(64))).count()
    assert buckets.agg(F.max("count")).first()[0] < 2 * len(rows) / 64
    out = sharding.shuffled(df, bucket_bytes=64 << 10)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert len({(r.shard, r.slot) for r in got}) == len(rows) and max(r.slot for r in got) == (len(rows) - 1) // 16
    assert spark_rows(out) == spark_rows(sharding.shuffled(df.repartition(3), bucket_bytes=64 << 10))


def test_brute_force_of_the_query(spark):
    """Sizes, checksums, and places that no partition setting changes."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    out = {r.doc_id: r for r in queries.op8_sharding(spark, SF_DIR).collect()}
    assert {i: (r.size, r.text_crc32, r.law, r.grown_shard) for i, r in out.items()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in docs.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = {r.doc_id: (r.shard, r.slot) for r in queries.op8_sharding(spark, SF_DIR).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert again == {i: (r.shard, r.slot) for i, r in out.items()}
    order = [i for _, i in sorted(((r.slot, r.shard), i) for i, r in out.items())]
    assert abs(sum(a < b for a, b in zip(order, order[1:], strict=False)) / len(order) - 0.5) < 0.15, "neighbours stand in no order"


def test_sharding_of_awkward_rows(spark):
    rows = [(None, None, 1), (None, "", 2), (1, "a", 3), (1, "a", 3), (1, "a", 3), (2, "x" * 3_000_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shuffled(df)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((a, b) for a, b, _ in rows)
    assert {(r.shard, r.slot) for r in out.collect()} == {(i, 0) for i in range(6)}
