"""The corpus pipeline: each stage takes what its predecessor kept.

Stages read and return the columns of `documents`; the last returns the encoded corpus.  Extra columns
come back unchanged, whatever their names; empty tables give empty results; very long texts are
worked on whole; what nulls, ties and repeated rows give stands at each stage.

The near-duplicate stage is asked for five-word similarity of 0.8 or more.  It begins with the classes of operator 7,
checked exactly; MinHash bands add what its fingerprints can't reach (`similar.py`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelex.llm import bpe, mixing, quality_rules, secret_scan, similar
from kinelex.llm.common import stored, table


def vocabulary() -> str:
    """The file that the last stage encodes with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines.

    Null, empty and blank texts go; nulls elsewhere stay; repeated rows are judged alike.
    """
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each component of texts with five-word similarity 0.8 or more.

    A null doc_id comes after all others; null and blank texts are one component; of rows that tie
    or repeat exactly one stays.
    """
    return similar.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; null and empty texts and repeated rows stay as they are."""
    return secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_findings(spark)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as its source's budget takes it.

    A null source is one of its own; a null text has no words; each repeated row is taken by itself, and
    ties of the hash-random keys are ordered by doc_id and size.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus as tokens: doc_id, n_tokens, ids and the decoded text's hash; a row per row, null texts as empty ones."""
    out = bpe.encode_decode(docs, vocabulary())
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixture), ("encoding", encode)]

#: The secret stage's forest and the similarity have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
