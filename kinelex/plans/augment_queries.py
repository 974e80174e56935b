"""Queries of augmentation, look-ups, contact merging, code names and action sentences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.exprs import uniform_sql
from ..operators import augment, codes, dataset, pairs, realize, rewrite, text
from . import catalog
from . import oracle as sql
from .queries import bodies, poses, query, rounded, table
from .text_queries import CONTACTS, FLIP_SQL, FLIPPED, FORMATTED, ITEMS, TOKEN_SQL, benchmark_texts, caption_rows, contacts, items, settled

PLAIN_FLIP = FLIP_SQL.replace(FLIPPED, "SELECT item_id AS id, text FROM benchmark")
_left, _right = catalog.AT["left_wrist"] + 1, catalog.AT["right_wrist"] + 1


@query(
    "q_random_flip",
    f"""WITH {sql.POSES}, turned AS ({PLAIN_FLIP}), raw AS (SELECT item_id AS id, array_to_string(regexp_extract_all(lower(text), '{TOKEN_SQL}'), ' ') AS text FROM benchmark),
d AS (SELECT id, p, raw.text, turned.flipped AS other, turned.flipped IS NOT NULL AND {uniform_sql(0, 'flip', 'id')} < 0.5 AS flipped FROM raw JOIN turned USING (id) JOIN poses ON pose_id = id)
SELECT id AS data_id, flipped, CASE WHEN flipped THEN other ELSE text END AS text, CASE WHEN flipped THEN p[{_right}][1] ELSE p[{_left}][1] END AS x, CASE WHEN flipped THEN -p[{_right}][2] ELSE p[{_left}][2] END + 0.0 AS y, CASE WHEN flipped THEN -p[{_right}][3] ELSE p[{_left}][3] END + 0.0 AS z FROM d""",
)
def random_flip(spark, sf_dir):
    t = benchmark_texts(spark, sf_dir).select("data_id", text.tokens(F.col("text")).alias("tokens"))
    b = bodies(spark, sf_dir).select(F.col("pose_id").alias("data_id"), "body")
    w = F.col("body")[catalog.AT["left_wrist"]]
    out = augment.flip_at_random(b.join(t, "data_id"))
    return out.select("data_id", "flipped", F.array_join("tokens", " ").alias("text"), w["x"].alias("x"), (w["y"] + 0.0).alias("y"), (w["z"] + 0.0).alias("z"))


@query(
    "q_copy_augmentation",
    f"""WITH {sql.PAIRS}, d AS (SELECT pair_id, pose_a, pose_b, text, pair_id % 2 = 0 AS single, {uniform_sql(0, 'copy', 'pair_id')} < 0.3 AS copied FROM pairs JOIN benchmark ON item_id = pair_id)
SELECT pair_id AS data_id, copied, CASE WHEN copied AND single THEN pose_b ELSE pose_a END AS pose_a, CASE WHEN copied AND NOT single THEN pose_a ELSE pose_b END AS pose_b, CASE WHEN copied THEN '' ELSE text END AS text FROM d""",
)
def copy_augmentation(spark, sf_dir):
    """Pairs of an even id stand for single poses."""
    p = pairs.pairs_of(poses(spark, sf_dir)).select(F.col("pair_id").alias("data_id"), "pose_a", "pose_b").join(benchmark_texts(spark, sf_dir), "data_id")
    return augment.copy_at_random(p, "pose_a", "pose_b", F.col("data_id") % 2 == 0, 0.3).select("data_id", "copied", "pose_a", "pose_b", "text")


VAL = "SELECT vec_id AS data_id FROM embeddings WHERE vec_id % 10 = 8"


def val_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("data_id"))
    return ids.where(dataset.split_of(F.col("data_id")) == "val")


@query("q_pose_scan", f"WITH v AS ({VAL}), {sql.POSES} SELECT pose_id, round(p[{_left}][1], 6) + 0.0 AS x FROM poses WHERE pose_id IN (SELECT data_id FROM v)")
def pose_scan(spark, sf_dir):
    out = dataset.pose_scan(val_ids(spark, sf_dir), bodies(spark, sf_dir))
    return rounded(out.select("pose_id", F.col("body")[catalog.AT["left_wrist"]]["x"].alias("x")), "x")


@query("q_lookup", f"WITH v AS ({VAL}), {ITEMS} SELECT row_number() OVER (ORDER BY data_id) - 1 AS number, data_id, md5(coalesce(texts[1], '')) AS text_md5 FROM v LEFT JOIN items USING (data_id)")
def lookup(spark, sf_dir):
    return dataset.lookup(val_ids(spark, sf_dir), items(spark, sf_dir)).select("number", "data_id", F.md5("text").alias("text_md5"))


@query("q_swap_texts", f"WITH {sql.PAIRS} SELECT pair_id, pose_a, pose_b, md5(text) AS text_md5 FROM pairs JOIN benchmark ON item_id = pair_id")
def swap_texts(spark, sf_dir):
    p = pairs.pairs_of(poses(spark, sf_dir)).withColumn("texts", F.array(F.lit("old")))
    other = dataset.captions(caption_rows(spark, sf_dir)[1:])
    return dataset.with_texts(p, other, "pair_id").select("pair_id", "pose_a", "pose_b", F.md5(F.get("texts", F.lit(0))).alias("text_md5"))


@query("q_first_items", f"WITH {ITEMS} SELECT data_id, len(texts) AS n_texts FROM items ORDER BY data_id LIMIT 20")
def first_items(spark, sf_dir):
    return dataset.first_items(items(spark, sf_dir).select("data_id", F.size("texts").alias("n_texts")), 20, "data_id")


@query("q_distinct_in_order", "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS seen FROM events WHERE event_type IS NOT NULL GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS types FROM f GROUP BY user_id")
def distinct_in_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type is not null")
    return dataset.distinct_in_order(e, "user_id", "event_type", "ts", "event_id").select("user_id", F.array_join("values", ",").alias("types"))


@query(
    "q_contact_merge",
    f"""WITH {FORMATTED}, {CONTACTS.removeprefix(sql.POSES + ', ')}
SELECT pose_id, side1, part1, intptt, side2, part2 FROM rows r WHERE NOT (intptt = 'close' AND EXISTS (SELECT 1 FROM contacts c WHERE c.pose_id = r.pose_id AND c.part1 = r.part1 AND c.part2 = r.part2 AND c.side1 IS NOT DISTINCT FROM r.side1 AND c.side2 IS NOT DISTINCT FROM r.side2))
UNION ALL SELECT pose_id, side1, part1, 'touch', side2, part2 FROM contacts""",
)
def contact_merge(spark, sf_dir):
    return rewrite.merge_contacts(rewrite.formatted(settled(spark, sf_dir)[1]), contacts(spark, sf_dir))


_letter = "CASE side{} WHEN 'left' THEN 'L ' WHEN 'right' THEN 'R ' ELSE '' END"
_kinds = sql.values([(i, c.kind) for i, c in enumerate(catalog.CODES)])


@query(
    "q_code_names",
    f"""WITH {FORMATTED}, n AS (SELECT code_id, intptt_id, count(*) AS n FROM facts GROUP BY ALL)
SELECT '[' || kind || '] ' || CASE WHEN part2 IS NULL THEN {_letter.format(1)} || part1 WHEN part1 = part2 THEN upper(side1[1]) || '/' || upper(side2[1]) || ' ' || part1 WHEN side1 = side2 THEN upper(side1[1]) || ' ' || part1 || '-' || part2
  ELSE {_letter.format(1)} || part1 || ' - ' || {_letter.format(2)} || part2 END || ' (' || intptt || ')' AS name, kind, side1, part1, intptt, side2, part2, n FROM n JOIN fmt USING (code_id, intptt_id) JOIN {_kinds} k(code_id, kind) USING (code_id)""",
)
def code_names(spark, sf_dir):
    """The name of every code that occurs, and what its name reads back as."""
    n = codes.measure(poses(spark, sf_dir)).groupBy("code_id", "intptt_id").agg(F.count("*").alias("n"))
    parts = [F.col(c) for c in ("kind", "side1", "part1", "intptt", "side2", "part2")]
    named = n.join(F.broadcast(rewrite.format_table(spark)), ["code_id", "intptt_id"]).select(rewrite.code_name(*parts).alias("name"), "n")
    return named.withColumn("c", rewrite.parse_name(F.col("name"))).select("name", "c.*", "n")


_cases = " ".join(f"WHEN draw < {b!r}::DOUBLE THEN '{w}'" for w, b in zip(realize.DETERMINERS, realize.BOUNDS, strict=False))


@query(
    "q_action_prefix",
    f"""WITH e AS (SELECT user_id, count(*) AS n, arg_min(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id),
d AS (SELECT user_id AS data_id, 'Events: ' || n || '.' AS text, CASE user_id % 4 WHEN 0 THEN 'They are at a ' || t || '. ' WHEN 1 THEN 'The human is at a ' || t || '. ' WHEN 2 THEN 'Someone is at a ' || t || '. ' END AS action, {uniform_sql(0, 'determiner', 'user_id')} AS draw FROM e),
w AS (SELECT *, CASE {_cases} ELSE '{realize.DETERMINERS[-1]}' END AS determiner FROM d)
SELECT data_id, determiner, coalesce(CASE WHEN determiner NOT IN ('his', 'her') THEN action WHEN starts_with(action, 'They ') THEN replace(replace(action, 'They', CASE determiner WHEN 'his' THEN 'He' ELSE 'She' END), ' are ', ' is ')
  WHEN starts_with(action, 'The human ') THEN replace(action, ' human ', CASE determiner WHEN 'his' THEN ' man ' ELSE ' woman ' END) ELSE action END, '') || text AS text FROM w""",
)
def action_prefix(spark, sf_dir):
    """A user's first event is the action; every fourth user has none."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("event_type", F.struct("ts", "event_id")).alias("t"))
    kind = F.col("user_id") % 4
    start = F.when(kind == 0, "They are at a ").when(kind == 1, "The human is at a ").when(kind == 2, "Someone is at a ")
    d = e.select(F.col("user_id").alias("data_id"), F.concat(F.lit("Events: "), F.col("n").cast("string"), F.lit(".")).alias("text"), F.concat(start, "t", F.lit(". ")).alias("action"), realize.determiner(F.col("user_id")).alias("determiner"))
    return d.select("data_id", "determiner", realize.with_action(F.col("text"), F.col("action"), F.col("determiner")).alias("text"))


@query("q_pose_parts", "SELECT vec_id AS pose_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z, len(embedding[4:66]) AS n_body, len(embedding[67:]) AS n_hands, round(list_sum(embedding[4:66]::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def pose_parts(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pose_id"), vectors.pose_parts(F.col("embedding")).alias("p"))
    total = F.aggregate("p.body", F.lit(0.0), lambda s, x: s + x.cast("double"))
    root = [F.col("p.root")[i].alias(c) for i, c in enumerate("xyz")]
    return rounded(p.select("pose_id", *root, F.size("p.body").alias("n_body"), F.size("p.hands").alias("n_hands"), total.alias("total")), "total")


@query("q_l2_norm", "WITH n AS (SELECT vec_id, embedding, greatest(sqrt(list_sum([x * x for x in embedding::DOUBLE[]])), 1e-12) AS n FROM embeddings) SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) + 0.0 AS first, round(embedding[64]::DOUBLE / n, 6) + 0.0 AS last FROM n")
def l2_norm(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalised(F.col("embedding")).alias("v"))
    return rounded(v.select("vec_id", F.col("v")[0].alias("first"), F.col("v")[63].alias("last")), "first", "last")


@query("q_padding_mask", f"SELECT item_id AS data_id, rpad(repeat('1', least(n, 64)::INT), 64, '0') AS mask FROM (SELECT item_id, len(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS n FROM benchmark)")
def padding_mask(spark, sf_dir):
    t = benchmark_texts(spark, sf_dir).select("data_id", vectors.padding_mask(F.size(text.tokens(F.col("text"))), 64).alias("mask"))
    return t.select("data_id", F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))


@query(
    "q_masked_mean",
    "SELECT vec_id, " + ", ".join(f"round(list_avg([embedding[4 * i + {k + 1}]::DOUBLE for i in range(vec_id % 16 + 1)]), 6) + 0.0 AS m{k}" for k in range(4)) + " FROM embeddings",
)
def masked_mean(spark, sf_dir):
    """A vector is sixteen tokens of four components, of which an item has from one to all."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    v = table(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("v"), vectors.padding_mask(F.col("vec_id") % 16 + 1, 16).alias("m"))
    means = v.select("vec_id", vectors.masked_mean(F.col("v"), F.col("m"), 4).alias("m"))
    return rounded(means.select("vec_id", *(F.col("m")[k].alias(f"m{k}") for k in range(4))), "m0", "m1", "m2", "m3")
