"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, embedding_dedup, language_id, mixing, quality_rules, secret_scan, sharding, simhash, spelling_variants, substring_dedup, suffix_dedup, token_alignment
from .common import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = language_id.fit(docs.where(~held_out).select("lang", "text"))
    out = language_id.predict(docs.select("doc_id", "text"), model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), forest)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat_format.format_conversations(rows).withColumn("turns", chat_format.parse(F.col("formatted")))
    everything = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = chat_format.learned(F.col("formatted"), F.col("mask"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(everything, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).withColumnRenamed("id", "vec_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling_variants.counts(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=97)
    words = stored(counts.where((F.length("word") >= 5) & (F.col("n") >= 3)), "words")
    return spelling_variants.variants(words, shortest=5).select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"), "longest")


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_mixing": op3_mixing,
        "op4_secret_scan": op4_secret_scan,
        "op5_quality_rules": op5_quality_rules,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_simhash": op7_simhash,
        "op8_sharding": op8_sharding,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_bpe": op10_bpe,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_token_alignment": op12_token_alignment,
        "op13_substring_dedup": op13_substring_dedup,
    }


WORD_SQL = r"'[^\x20\x09-\x0D]+'"
TEXT_SQL = "coalesce(text, '')"

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all({TEXT_SQL}, {WORD_SQL})) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5({TEXT_SQL})), 1, 13) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE AS left_, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS rest
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, left_ * w >= cap * rest AS at_cap FROM l),
g AS (SELECT arg_max(left_, rest) AS ll, max(rest) AS lr FROM f WHERE NOT at_cap),
t AS (SELECT source, source_size, coalesce(CASE WHEN at_cap THEN cap::DOUBLE ELSE w * ll / lr END, 0) AS target FROM f LEFT JOIN g ON true),
c AS (
  SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN before + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c"""

LINE_FAILS_SQL = rf"""(n > 0 AND (
    (bars >= 2 AND bars * 5 >= n) OR marks * 2 >= n
    OR (n >= 3 AND regexp_matches(line, '\p{{Lu}}\p{{Lu}}') AND caps * 2 > letters)
    OR (n >= 3 AND NOT regexp_matches(line, '{quality_rules.TERMINAL_RE2}'))
    OR regexp_matches(line, '{quality_rules.BOILERPLATE}')))"""

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TEXT_SQL} AS t FROM documents),
ws AS (SELECT r, doc_id, t, regexp_extract_all(t, {WORD_SQL}) AS ws FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM ws WHERE len(ws) >= 3),
g AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM p),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n_repeat FROM h, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lc AS (
  SELECT r, line, len(regexp_extract_all(line, {WORD_SQL})) AS n,
         length(line) - length(translate(line, '|»›•', '')) AS bars, length(line) - length(translate(line, '{quality_rules.SYMBOLS}', '')) AS marks,
         len(regexp_extract_all(line, '\p{{Lu}}')) AS caps, len(regexp_extract_all(line, '\p{{L}}')) AS letters
  FROM lines),
ll AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup, coalesce(sum(n) FILTER ({LINE_FAILS_SQL}), 0) AS lost FROM lc GROUP BY r),
a AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines,
         coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, lost
  FROM ws JOIN ll USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * n_words AS kept
FROM a"""

_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')"

CHAT_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (
  SELECT *, CASE WHEN regexp_matches(text, '{chat_format.CONTROL}|{chat_format.REFERENCE}') THEN {_ESCAPED.format('text')} ELSE text END AS shown FROM r),
f AS (
  SELECT *, length(shown) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 16 + length({_ESCAPED.format('role')}) END AS n FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIX_SQL, "op5_quality_rules": QUALITY_SQL, "op6_chat_formatting": CHAT_SQL}
