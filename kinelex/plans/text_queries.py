"""Queries on datasets, texts and rewritten codes, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import uniform_sql
from ..functions.stages import stored
from ..operators import codes, dataset, pairs, realize, rewrite, text
from . import catalog
from . import oracle as sql
from .queries import pair_facts, poses, query, rounded, table
from ..functions import geometry as g

quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


# Datasets: conversations are captions of items, benchmark texts a second source, embeddings the poses.
def caption_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("data_id"), F.col("turn").alias("caption_idx"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("data_id"), F.lit(0).cast("long").alias("caption_idx"), "text")
    return [c, b]


def items(spark, sf_dir):
    return dataset.captions(caption_rows(spark, sf_dir))


ITEMS = """rows AS (SELECT conv_id AS data_id, 0 AS file, turn AS caption_idx, text FROM conversations UNION ALL SELECT item_id, 1, 0, text FROM benchmark),
items AS (SELECT data_id, list(text ORDER BY file, caption_idx, text) AS texts FROM rows WHERE text IS NOT NULL GROUP BY data_id)"""
SPLIT = "CASE WHEN data_id % 10 < 8 THEN 'train' WHEN data_id % 10 = 8 THEN 'val' ELSE 'test' END"


@query("q_caption_load", f"WITH {ITEMS} SELECT data_id, {SPLIT} AS split, len(texts) AS n_texts, md5(array_to_string(texts, '|')) AS texts_md5 FROM items WHERE data_id % 10 < 8")
def caption_load(spark, sf_dir):
    rows = caption_rows(spark, sf_dir)
    ids = rows[0].select("data_id").union(rows[1].select("data_id")).where(dataset.split_of(F.col("data_id")) == "train")
    return dataset.captions(rows, ids).select("data_id", dataset.split_of(F.col("data_id")).alias("split"), F.size("texts").alias("n_texts"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


@query("q_duplicate_captions", f"WITH {ITEMS} SELECT count(*) FILTER (len(texts) > 1) AS several, min(len(texts)) AS least FROM items")
def duplicate_captions(spark, sf_dir):
    return items(spark, sf_dir).agg(F.count_if(F.size("texts") > 1).alias("several"), F.min(F.size("texts")).alias("least"))


@query(
    "q_caption_choice",
    f"""WITH {ITEMS} SELECT data_id, md5(texts[1]) AS first, md5(texts[data_id % len(texts) + 1]) AS by_index, md5(texts[CAST(floor({uniform_sql(0, 'caption', 'data_id')} * len(texts)) AS INT) + 1]) AS drawn FROM items""",
)
def caption_choice(spark, sf_dir):
    i = items(spark, sf_dir)
    out = dataset.choose(i, 0).select("data_id", F.md5("text").alias("first"))
    for how, name in (("index", "by_index"), ("random", "drawn")):
        out = out.join(dataset.choose(i, how).select("data_id", F.md5("text").alias(name)), "data_id")
    return out


INFO = "info AS (SELECT vec_id AS pose_id, label AS sequence FROM embeddings)"
TRIPLETS = f"{ITEMS}, {sql.PAIRS}, {INFO}, triplets AS (SELECT pair_id, pose_a, pose_b, a.sequence = b.sequence AS in_sequence, texts FROM pairs JOIN items ON data_id = pair_id JOIN info a ON a.pose_id = pose_a JOIN info b ON b.pose_id = pose_b)"


def triplet_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pose_id"), F.col("label").alias("sequence"))
    return dataset.triplets(pairs.pairs_of(e), e, items(spark, sf_dir))


@query("q_triplets", f"WITH {TRIPLETS} SELECT pair_id, pose_a, pose_b, in_sequence, len(texts) AS n_texts FROM triplets")
def triplets(spark, sf_dir):
    return triplet_rows(spark, sf_dir).select("pair_id", "pose_a", "pose_b", "in_sequence", F.size("texts").alias("n_texts"))


@query(
    "q_mixed_dataset",
    f"WITH {TRIPLETS} SELECT 'pair_' || pair_id AS data_id, pose_a, pose_b, len(texts) AS n_texts FROM triplets UNION ALL SELECT 'pose_' || data_id, -1, data_id, len(texts) FROM items",
)
def mixed_dataset(spark, sf_dir):
    return dataset.mixed(triplet_rows(spark, sf_dir), items(spark, sf_dir))


@query("q_subset_filters", f"WITH {TRIPLETS} SELECT pair_id, in_sequence, pose_b IN (SELECT doc_id FROM labels) AS annotated FROM triplets")
def subset_filters(spark, sf_dir):
    t = triplet_rows(spark, sf_dir)
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pose_b"), F.lit(True).alias("annotated")).distinct()
    return t.join(known, "pose_b", "left").select("pair_id", "in_sequence", F.coalesce("annotated", F.lit(False)).alias("annotated"))


@query("q_control_subset", f"WITH {ITEMS} SELECT data_id, len(texts) + 1 AS n_texts, md5(array_to_string(list_prepend(b.text, texts), '|')) AS texts_md5 FROM items JOIN benchmark b ON item_id = data_id")
def control_subset(spark, sf_dir):
    auto = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("data_id"), "text")
    out = dataset.control_subset(items(spark, sf_dir), auto)
    return out.select("data_id", F.size("texts").alias("n_texts"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


# Sequences: a user's events; each event opens a span that ends with the user's next event.
def frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("sequence"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")


def spans(spark, sf_dir):
    w = Window.partitionBy("sequence").orderBy("us", "frame_id")
    return frames(spark, sf_dir).select("sequence", F.col("us").alias("start_t"), F.lead("us").over(w).alias("end_t"), F.col("event_type").alias("label")).where("end_t is not null")


SPANS = """frames AS (SELECT event_id AS frame_id, user_id AS sequence, epoch_us(ts) AS us, event_type FROM events),
spans AS (SELECT sequence, us AS start_t, lead(us) OVER (PARTITION BY sequence ORDER BY us, frame_id) AS end_t, event_type AS label FROM frames),
labels_ AS (SELECT frame_id, f.sequence, label FROM frames f JOIN spans s ON f.sequence = s.sequence AND us BETWEEN start_t AND end_t)"""


@query("q_interval_labels", f"WITH {SPANS} SELECT frame_id, sequence, label FROM labels_")
def interval_labels(spark, sf_dir):
    return dataset.interval_labels(frames(spark, sf_dir).withColumnRenamed("us", "t"), spans(spark, sf_dir))


@query(
    "q_label_histogram",
    f"""WITH {SPANS}, q AS (SELECT sequence, CASE WHEN sequence % 7 = 1 THEN '__ball__' WHEN sequence % 7 = 2 THEN '__dance__' END AS marker FROM (SELECT DISTINCT sequence FROM spans WHERE sequence % 7 > 0)),
l AS (SELECT frame_id, CASE WHEN label <> 'click' THEN label END AS label FROM labels_ WHERE label <> 'purchase'),
n AS (SELECT frame_id, count(*) AS n, count(*) - count(label) AS nulls FROM l GROUP BY 1)
SELECT CASE WHEN q.sequence IS NULL THEN 'none' WHEN marker IS NOT NULL THEN marker WHEN coalesce(n, 0) = 0 THEN '0 labels' WHEN nulls > 0 THEN 'null label' WHEN n = 1 THEN '1 label' ELSE '>1 labels' END AS bucket, count(*) AS frames
FROM frames f LEFT JOIN q USING (sequence) LEFT JOIN n USING (frame_id) GROUP BY 1""",
)
def label_histogram(spark, sf_dir):
    """Of every seven sequences one is not annotated and two have only a marker; one type of event has no label, one type a null label."""
    f, s = frames(spark, sf_dir).withColumnRenamed("us", "t"), spans(spark, sf_dir)
    kind = F.col("sequence") % 7
    listed = s.where(kind > 0).select("sequence", F.when(kind == 1, "__ball__").when(kind == 2, "__dance__").alias("marker")).distinct()
    labels = dataset.interval_labels(f, s).where("label <> 'purchase'").select("frame_id", F.when(F.col("label") != "click", F.col("label")).alias("label"))
    return dataset.label_histogram(labels, f, listed)


@query("q_json_map", "SELECT event_id AS data_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_map(spark, sf_dir):
    from ..sources.maps import values_of

    return values_of(table(spark, sf_dir, "events").select(F.col("event_id").alias("data_id"), "props"), "props", "map<string,bigint>").where("key = 'k'").select("data_id", F.col("value").alias("k"))


# Texts.
TOKEN_SQL = r"""[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"""
VOCAB = f"""tok AS (SELECT item_id AS data_id, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS ts FROM benchmark),
words AS (SELECT data_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS word FROM tok),
seen AS (SELECT word, count(*) AS n, min((data_id, pos)) AS first FROM words GROUP BY word HAVING count(*) >= 2),
vocab AS (SELECT word, row_number() OVER (ORDER BY first, word) + 3 AS idx FROM seen UNION ALL VALUES ('<pad>', 0), ('<start>', 1), ('<end>', 2), ('<unk>', 3))"""


def benchmark_texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("data_id"), "text")


@query("q_vocab", f"WITH {VOCAB} SELECT word, idx FROM vocab")
def vocab(spark, sf_dir):
    return text.vocabulary(benchmark_texts(spark, sf_dir))


ENCODED = f"""{VOCAB}, enc AS (SELECT data_id, list_concat(list_concat([1], (list(coalesce(idx, 3) ORDER BY pos))[1:498]), [2]) AS ids FROM words LEFT JOIN vocab USING (word) GROUP BY data_id)"""


@query("q_encode_tokens", f"WITH {ENCODED} SELECT data_id, array_to_string(ids, ' ') AS ids, len(ids) AS length FROM enc")
def encode_tokens(spark, sf_dir):
    t = benchmark_texts(spark, sf_dir)
    return text.encode(t, text.vocabulary(t)).select("data_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "length")


@query(
    "q_decode_tokens",
    f"""WITH {VOCAB}, j AS (SELECT data_id, regexp_replace(string_agg(word, ' ' ORDER BY pos), ' ([.,;:!?])', '\\1', 'g') AS s FROM words JOIN vocab USING (word) WHERE pos < 498 GROUP BY data_id)
SELECT data_id, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(s, '. ')], '. ') AS text FROM j""",
)
def decode_tokens(spark, sf_dir):
    t = benchmark_texts(spark, sf_dir)
    v = text.vocabulary(t)
    return text.decode(text.encode(t, v), v)


@query("q_embedding_coverage", f"WITH {VOCAB}, d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS word, 1 AS has FROM documents) SELECT count(has) AS found, count(*) - count(has) AS missing FROM vocab LEFT JOIN d USING (word)")
def embedding_coverage(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return text.coverage(text.vocabulary(benchmark_texts(spark, sf_dir)), known)


_flips = {**text.FLIPS, **{v: k for k, v in text.FLIPS.items() if k != "clockwise"}, "counterclockwise": "clockwise", **dict.fromkeys(text.ALSO_CLOCKWISE, "clockwise")}
#: The texts flipped are those of the benchmark, and descriptions of sides with a benchmark text behind them.
FLIPPED = "SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -1 - item_id, CASE item_id % 4 WHEN 0 THEN 'turn to the right, ' WHEN 1 THEN 'the left hand is right behind the head: ' WHEN 2 THEN 'look at the right behind ' ELSE 'at ten o''clock ' END || text FROM benchmark"
FLIP_SQL = f"""WITH t AS (SELECT id, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS ts FROM ({FLIPPED})),
w AS (SELECT id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS w FROM t WHERE NOT list_has_any(ts, [{quoted(text.GUARDS)}])),
n AS (SELECT *, coalesce(lag(w) OVER o, '') AS b, coalesce(lead(w) OVER o, '') AS a FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
f AS (SELECT id, pos, CASE WHEN w = 'right' AND (b IN ({quoted(text.AFTER_BE)}) OR a IN ({quoted(text.ANGLES)}) OR (a IN ({quoted(text.PREPOSITIONS)}) AND b NOT IN ({quoted(text.DETERMINERS)}))) THEN w
  ELSE coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in _flips.items())}}}[w], w) END AS w FROM n)
SELECT t.id, string_agg(f.w, ' ' ORDER BY pos) AS flipped FROM t LEFT JOIN f USING (id) GROUP BY t.id"""


@query("q_mirror_text", FLIP_SQL)
def mirror_text(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    start = F.when(F.col("id") % 4 == 0, "turn to the right, ").when(F.col("id") % 4 == 1, "the left hand is right behind the head: ").when(F.col("id") % 4 == 2, "look at the right behind ").otherwise("at ten o'clock ")
    t = b.unionByName(b.select((-1 - F.col("id")).alias("id"), F.concat(start, "text").alias("text"))).select("id", text.tokens(F.col("text")).alias("ts"))
    return t.select("id", F.array_join(text.flip(F.col("ts")), " ").alias("flipped"))


def flip_texts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    start = F.when(F.col("id") % 4 == 0, "turn anti-clockwise to the right, ").when(F.col("id") % 4 == 1, "the left-hand is right behind the head, clockwise: ").when(F.col("id") % 4 == 2, "look at the right behind, counter-clockwise ").otherwise("at ten o'clock ")
    return b.unionByName(b.select((-1 - F.col("id")).alias("id"), F.concat(start, "text").alias("text")))


@query("q_flip_ids")
def flip_ids(spark, sf_dir):
    """Ids of pieces of words with the sides exchanged, and whether the way there and back gives the same ids."""
    rows = flip_texts(spark, sf_dir).select("id", F.regexp_extract_all(F.lower("text"), F.lit(text.PIECE), F.lit(0)).alias("pieces"))
    words = rows.select(F.explode("pieces").alias("word")).distinct()
    vocab = text.in_order(words, "word").select("word", F.col("place").cast("int").alias("idx"))
    known = text.flip_table(vocab)
    ids = rows.select("id", F.posexplode("pieces").alias("pos", "word")).join(vocab, "word").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias("own"))
    one = text.to_flip_ids(F.col("own"), known)
    join = lambda c: F.array_join(c.cast("array<string>"), " ")
    return ids.select("id", join(F.col("own")).alias("ids"), join(text.flip_ids(F.col("own"), known)).alias("flipped"), F.size(one).alias("n_one"), (text.from_flip_ids(one, known) == F.col("own")).alias("round_trip"))


_swap = {"left": "right", "right": "left"}
_from = [catalog.AT["_".join([_swap.get(n.split("_")[0], n.split("_")[0]), *n.split("_")[1:]])] + 1 for n in catalog.BODY]


@query("q_mirror_pose", f"WITH {sql.POSES} SELECT pose_id, i - 1 AS joint, p[m][1] AS x, -p[m][2] + 0.0 AS y, -p[m][3] + 0.0 AS z FROM poses, {sql.values([(i + 1, m) for i, m in enumerate(_from)])} t(i, m)")
def mirror_pose(spark, sf_dir):
    b = g.pose_view(table(spark, sf_dir, "embeddings"))
    out = b.select("pose_id", F.posexplode(g.mirrored(F.col("body"))).alias("joint", "p"))
    return out.select("pose_id", "joint", "p.x", (F.col("p.y") + 0.0).alias("y"), (F.col("p.z") + 0.0).alias("z"))


@query(
    "q_tag_sentences",
    f"""WITH u AS (SELECT user_id AS data_id, list_distinct(list(event_type) FILTER (event_type IS NOT NULL)) AS tags FROM events GROUP BY user_id),
t AS (SELECT data_id, unnest(tags) AS tag FROM u), r AS (SELECT data_id, list(tag ORDER BY {uniform_sql(0, 'tag', 'data_id', 'tag')}, tag) AS d FROM t GROUP BY data_id)
SELECT data_id, CASE WHEN len(d) = 1 THEN 'Someone does: ' || d[1] || '.' ELSE 'Someone does: ' || d[1] || CASE WHEN {uniform_sql(0, 'join', 'data_id')} < 0.5 THEN ' and ' ELSE ' while ' END || d[2] || '.' END AS text FROM r""",
)
def tag_sentences(spark, sf_dir):
    tags = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("data_id")).agg(F.array_append(F.collect_set("event_type"), F.lit("__marker__")).alias("tags"))
    return realize.tag_sentence(tags)


# Rewriting of codes.
_format_rows = []
for _i, _c in enumerate(catalog.CODES):
    _first = _c.focus or _c.joints[0]
    _second = None if _c.kind in rewrite.FOCUS_KINDS else next(j for j in (_c.joints[1], _c.joints[0]) if j != _first)
    for _n, _name in enumerate(catalog.KINDS[_c.kind].categories):
        _format_rows.append((_i, catalog.OFFSET[_c.kind] + _n, *rewrite.split_side(_first), _name, *rewrite.split_side(_second)))
FORMATTED = f"""{sql.resolved()}, fmt AS (SELECT * FROM {sql.values(_format_rows)} t(code_id, intptt_id, side1, part1, intptt, side2, part2)),
rows AS (SELECT pose_id, code_id, intptt_id, side1, part1, intptt, side2, part2 FROM resolved JOIN fmt USING (code_id, intptt_id) WHERE elig > 0)"""


def settled(spark, sf_dir):
    facts = stored(codes.measure(poses(spark, sf_dir)).select("pose_id", "code_id", "intptt_id"), "facts")
    return facts, codes.resolve_support(codes.eligibility(facts), codes.super_codes(facts))


_ord = sql.values([(k, a, b) for k, (a, b) in rewrite.ORDERINGS.items()])


@query(
    "q_transitive_prune",
    f"""WITH {FORMATTED}, e AS (SELECT pose_id, code_id, axis, CASE WHEN less = 1 THEN concat_ws('_', side1, part1) ELSE concat_ws('_', side2, part2) END AS lo, CASE WHEN less = 1 THEN concat_ws('_', side2, part2) ELSE concat_ws('_', side1, part1) END AS hi
  FROM rows JOIN {_ord} o(intptt, axis, less) USING (intptt) WHERE part2 IS NOT NULL)
SELECT pose_id, code_id, intptt FROM rows r WHERE NOT EXISTS (SELECT 1 FROM e JOIN e x ON x.pose_id = e.pose_id AND x.axis = e.axis AND x.lo = e.lo JOIN e y ON y.pose_id = e.pose_id AND y.axis = e.axis AND y.lo = x.hi AND y.hi = e.hi
  WHERE e.pose_id = r.pose_id AND e.code_id = r.code_id)""",
)
def transitive_prune(spark, sf_dir):
    return rewrite.prune_transitive(rewrite.formatted(settled(spark, sf_dir)[1])).select("pose_id", "code_id", "intptt")


_ent = sql.values([*rewrite.ENTITIES, *((y, x, e) for x, y, e in rewrite.ENTITIES)])
ENTITY = f"""{FORMATTED}, r AS (SELECT DISTINCT pose_id, side1, part1, intptt, side2, part2 FROM rows), ent AS (SELECT * FROM {_ent} t(x, y, entity)),
both_ AS (SELECT a.pose_id, a.side1, a.intptt, a.side2, a.part1 AS a1, a.part2 AS a2, b.part1 AS b1, b.part2 AS b2, coalesce(t.entity, b.part1) AS m1, coalesce(u.entity, b.part2) AS m2
  FROM r a JOIN r b ON b.pose_id = a.pose_id AND b.intptt = a.intptt AND b.side1 IS NOT DISTINCT FROM a.side1 AND b.side2 IS NOT DISTINCT FROM a.side2
  LEFT JOIN ent t ON a.part1 = t.x AND b.part1 = t.y LEFT JOIN ent u ON a.part2 = u.x AND b.part2 = u.y
  WHERE (t.entity IS NOT NULL AND (u.entity IS NOT NULL OR a.part2 IS NOT DISTINCT FROM b.part2)) OR (u.entity IS NOT NULL AND a.part1 = b.part1)),
merged AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.pose_id = r.pose_id AND b.intptt = r.intptt AND b.side1 IS NOT DISTINCT FROM r.side1 AND b.side2 IS NOT DISTINCT FROM r.side2 AND b.a1 = r.part1 AND b.a2 IS NOT DISTINCT FROM r.part2)
  UNION SELECT pose_id, side1, m1, intptt, side2, m2 FROM both_)"""


@query("q_entity_merge", f"WITH {ENTITY} SELECT * FROM merged")
def entity_merge(spark, sf_dir):
    return rewrite.merge_entities(rewrite.formatted(settled(spark, sf_dir)[1]))


@query(
    "q_symmetry_merge",
    f"""WITH {FORMATTED}, s AS (SELECT pose_id, part1, intptt, part2, count(DISTINCT side2) AS n2, min(side2) AS one FROM rows WHERE side1 IN ('left', 'right') GROUP BY ALL HAVING count(DISTINCT side1) = 2)
SELECT pose_id, side1, part1, intptt, side2, part2 FROM rows r WHERE side1 IS NULL OR side1 NOT IN ('left', 'right') OR NOT EXISTS (SELECT 1 FROM s WHERE s.pose_id = r.pose_id AND s.part1 = r.part1 AND s.intptt = r.intptt AND s.part2 IS NOT DISTINCT FROM r.part2)
UNION ALL SELECT pose_id, 'both', part1, intptt, CASE WHEN n2 > 1 THEN 'both' ELSE one END, part2 FROM s""",
)
def symmetry_merge(spark, sf_dir):
    return rewrite.merge_symmetric(rewrite.formatted(settled(spark, sf_dir)[1]))


_rules = sql.values(rewrite.rule_rows())


@query(
    "q_stat_prune",
    f"""WITH {sql.resolved()}, hit AS (SELECT a.pose_id, cc, ic FROM facts a JOIN {_rules} r(rule, ca, ia, cb, ib, cc, ic) ON a.code_id = ca AND a.intptt_id = ia
  WHERE cb < 0 OR EXISTS (SELECT 1 FROM facts b WHERE b.pose_id = a.pose_id AND b.code_id = cb AND b.intptt_id = ib))
SELECT pose_id, code_id, intptt_id FROM resolved s WHERE elig > 0 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.pose_id = s.pose_id AND cc = code_id AND ic = intptt_id)""",
)
def stat_prune(spark, sf_dir):
    facts, kept = settled(spark, sf_dir)
    return rewrite.prune_statistical(kept.where("elig > 0"), facts.select("pose_id", "code_id", "intptt_id")).select("pose_id", "code_id", "intptt_id")


_opp = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in catalog.OPPOSITES.items()) + "}"


@query(
    "q_side_reversal",
    f"""WITH {FORMATTED}, t AS (SELECT *, part1 = part2 AND side1 IS DISTINCT FROM side2 AND {uniform_sql(0, 'reverse', 'pose_id', 'part1', 'intptt')} < 0.5 AS turn FROM rows)
SELECT pose_id, code_id, CASE WHEN turn THEN side2 ELSE side1 END AS side1, part1, CASE WHEN turn THEN coalesce({_opp}[intptt], intptt) ELSE intptt END AS intptt, CASE WHEN turn THEN side1 ELSE side2 END AS side2, part2 FROM t""",
)
def side_reversal(spark, sf_dir):
    return rewrite.reverse(rewrite.formatted(settled(spark, sf_dir)[1]))


@query(
    "q_fusion_deterministic",
    f"""WITH {FORMATTED}, r AS (SELECT pose_id, intptt || '|' || coalesce(side2, '') || '|' || coalesce(part2, '') AS pred, coalesce(side1, '') || '|' || part1 AS subj FROM rows),
n AS (SELECT *, count(*) OVER (PARTITION BY pose_id, pred) AS np, count(*) OVER (PARTITION BY pose_id, subj) AS ns FROM r),
h AS (SELECT *, CASE WHEN np > 1 AND np >= ns THEN 'predicate' WHEN ns > 1 THEN 'subject' ELSE 'alone' END AS how FROM n)
SELECT pose_id, how, CASE how WHEN 'predicate' THEN pred WHEN 'subject' THEN subj ELSE subj || '#' || pred END AS key, count(*) AS n FROM h GROUP BY ALL""",
)
def fusion(spark, sf_dir):
    return rewrite.fuse(rewrite.formatted(settled(spark, sf_dir)[1]))


@query(
    "q_collapse",
    f"""WITH {FORMATTED}, t AS (SELECT *, coalesce(part1 = part2, false) AND intptt IN ({quoted(rewrite.SHARED)}) AND {uniform_sql(0, 'collapse', 'pose_id', 'part1', 'intptt')} < 0.5 AS one FROM rows)
SELECT pose_id, code_id, CASE WHEN one THEN 'both' ELSE side1 END AS side1, part1, intptt, CASE WHEN NOT one THEN side2 END AS side2, CASE WHEN NOT one THEN part2 END AS part2 FROM t""",
)
def collapse(spark, sf_dir):
    return rewrite.collapse(rewrite.formatted(settled(spark, sf_dir)[1])).select("pose_id", "code_id", "side1", "part1", "intptt", "side2", "part2")


@query(
    "q_omit_second",
    f"""WITH {FORMATTED}, t AS (SELECT *, coalesce((part2 = 'torso' AND intptt IN ('behind', 'front')) OR (part1 = 'hand' AND part2 = 'shoulder' AND intptt IN ('at_right', 'at_left')) OR (part1 = 'foot' AND part2 = 'hip' AND intptt IN ('at_right', 'at_left'))
  OR (part1 IN ('hand', 'wrist') AND part2 = 'neck' AND intptt = 'above'), false) AS gone FROM rows)
SELECT pose_id, code_id, side1, part1, intptt, CASE WHEN NOT gone THEN side2 END AS side2, CASE WHEN NOT gone THEN part2 END AS part2 FROM t""",
)
def omit_second(spark, sf_dir):
    return rewrite.omit_second(rewrite.formatted(settled(spark, sf_dir)[1])).select("pose_id", "code_id", "side1", "part1", "intptt", "side2", "part2")


# Contacts: parts of limbs within a quarter of a metre.
_arm, _leg = [f"{s}_{p}" for s in ("left", "right") for p in ("hand", "wrist", "elbow", "forearm")], [f"{s}_{p}" for s in ("left", "right") for p in ("foot", "ankle", "knee", "thigh")]
_contact_rows = [(*rewrite.split_side(a), *rewrite.split_side(b), catalog.AT[a] + 1, catalog.AT[b] + 1) for a in _arm for b in [*_leg, "torso"]]
CONTACTS = f"""{sql.POSES}, contacts AS (SELECT pose_id, side1, part1, side2, part2 FROM poses, {sql.values(_contact_rows)} t(side1, part1, side2, part2, a, b)
  WHERE sqrt((p[a][1] - p[b][1]) * (p[a][1] - p[b][1]) + (p[a][2] - p[b][2]) * (p[a][2] - p[b][2]) + (p[a][3] - p[b][3]) * (p[a][3] - p[b][3])) < 0.25)"""


def contacts(spark, sf_dir):
    rows = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("side1", "part1", "side2", "part2"), r[:4], strict=True)), F.lit(r[4] - 1).alias("a"), F.lit(r[5] - 1).alias("b")) for r in _contact_rows))
    near = F.filter(rows, lambda r: g.distance(F.col("joints")[r["a"]], F.col("joints")[r["b"]]) < 0.25)
    return poses(spark, sf_dir).select("pose_id", F.explode(near).alias("c")).select("pose_id", "c.side1", "c.part1", "c.side2", "c.part2")


_contains = sql.values([*rewrite.contains_rows(), *((p, p) for p in sorted({x for r in rewrite.contains_rows() for x in r}))])


@query(
    "q_inclusion_prune",
    f"""WITH {CONTACTS} SELECT pose_id, side1, part1, side2, part2 FROM contacts c WHERE NOT EXISTS (SELECT 1 FROM contacts w JOIN {_contains} x(whole, part) ON x.whole = w.part1 JOIN {_contains} y(whole, part) ON y.whole = w.part2
  WHERE w.pose_id = c.pose_id AND w.side1 IS NOT DISTINCT FROM c.side1 AND w.side2 IS NOT DISTINCT FROM c.side2 AND x.part = c.part1 AND y.part = c.part2 AND NOT (w.part1 = c.part1 AND w.part2 = c.part2))""",
)
def inclusion_prune(spark, sf_dir):
    return rewrite.prune_contained(contacts(spark, sf_dir))


@query(
    "q_contact_delta",
    f"""WITH {CONTACTS}, {sql.PAIRS}, k AS (SELECT pose_id, concat_ws('_', side1, part1) AS part1, concat_ws('_', side2, part2) AS part2 FROM contacts)
SELECT pair_id, part1, part2 FROM pairs JOIN k ON pose_id = pose_b EXCEPT SELECT pair_id, part1, part2 FROM pairs JOIN k ON pose_id = pose_a""",
)
def contact_delta(spark, sf_dir):
    k = contacts(spark, sf_dir).select("pose_id", F.concat_ws("_", "side1", "part1").alias("part1"), F.concat_ws("_", "side2", "part2").alias("part2"))
    return pairs.contact_delta(pairs.pairs_of(poses(spark, sf_dir)), k)


_order = sql.values(pairs.order_rows())
_focus = sql.values([(i, c.focus or c.joints[0]) for i, c in enumerate(catalog.CODES)])
_pair_focus = sql.values([(i, c.focus or c.joints[0]) for i, c in enumerate(catalog.PAIR_CODES)])
_mid = ", ".join(str(catalog.PAIR_OFFSET[k] + next(i for i, c in enumerate(v.categories) if "ignored" in c)) for k, v in catalog.PAIR_KINDS.items())


@query(
    "q_absolute_filter",
    f"""WITH {sql.pair_facts(('pair_angle', 'pair_distance', 'pair_relativePosX', 'pair_relativePosY', 'pair_relativePosZ', 'pair_bodyInclineX', 'pair_bodyInclineY', 'pair_bodyInclineZ'))}, {sql.code_table()}, o AS (SELECT * FROM {_order} t(part, branch, rank)),
changed AS (SELECT DISTINCT pair_id, part FROM pair_facts JOIN {_pair_focus} f(code_id, part) USING (code_id) WHERE intptt_id NOT IN ({_mid})),
b AS (SELECT pair_id, code_id, part FROM pairs JOIN facts ON pose_id = pose_b JOIN code_table USING (code_id, intptt_id) JOIN {_focus} f(code_id, part) USING (code_id) WHERE absolute = 1)
SELECT DISTINCT pair_id, code_id, part FROM b WHERE EXISTS (SELECT 1 FROM changed c WHERE c.pair_id = b.pair_id AND c.part = b.part)
  OR EXISTS (SELECT 1 FROM changed c JOIN o x ON x.part = c.part JOIN o y ON y.branch = x.branch WHERE c.pair_id = b.pair_id AND y.part = b.part AND y.rank > x.rank)""",
)
def absolute_filter(spark, sf_dir):
    p = poses(spark, sf_dir)
    ids, facts = pairs.pairs_of(p), codes.measure(p)
    focus = lambda cs: spark.createDataFrame([(i, c.focus or c.joints[0]) for i, c in enumerate(cs)], "code_id int, part string")
    d = pairs.direction_table(spark).where("direction <> 0").select("intptt_id")
    changed = pair_facts(spark, sf_dir, PAIR_ALL).join(F.broadcast(d), "intptt_id").join(F.broadcast(focus(catalog.PAIR_CODES)), "code_id").select("pair_id", "part")
    absolute = F.broadcast(codes.code_table(spark).where("absolute = 1").select("code_id", "intptt_id"))
    b = facts.join(absolute, ["code_id", "intptt_id"]).join(F.broadcast(focus(catalog.CODES)), "code_id").join(ids, F.col("pose_id") == F.col("pose_b")).select("pair_id", "code_id", "part")
    return pairs.facts_of_b(changed, b)


@query("q_describe")
def describe(spark, sf_dir):
    return realize.describe(poses(spark, sf_dir), contacts(spark, sf_dir))


PAIR_ALL = ("pair_angle", "pair_distance", "pair_relativePosX", "pair_relativePosY", "pair_relativePosZ", "pair_bodyInclineX", "pair_bodyInclineY", "pair_bodyInclineZ")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), (F.col("embedding")[63].cast("double") * 1000).alias("degrees"), "vec_id").where("vec_id % 2 = 0").drop("vec_id")


@query("q_instruct")
def instruct(spark, sf_dir):
    p = poses(spark, sf_dir)
    # a plan for each way of measuring: in one, they take the driver's memory together
    changes = [stored(pair_facts(spark, sf_dir, tuple(k for k in PAIR_ALL if way in k)), "pair-facts") for way in ("angle", "distance", "relativePos", "Incline")]
    return realize.instruct(p, pairs.pairs_of(p), reduce(DataFrame.unionByName, changes), turns(spark, sf_dir), contacts(spark, sf_dir))


@query("q_rotation_change")
def rotation_change(spark, sf_dir):
    """Change of the root rotation of each pair, in degrees; B is turned to A's heading where both are of one sequence."""
    e = table(spark, sf_dir, "embeddings")
    b = g.pose_view(e).select("pose_id", F.col("body")[1].alias("root")).join(e.select(F.col("vec_id").alias("pose_id"), F.col("label").alias("sequence")), "pose_id")
    a = b.select(F.col("pose_id").alias("pose_a"), F.col("root").alias("ra"), F.col("sequence").alias("sa"))
    j = pairs.pairs_of(b).join(a, "pose_a").join(b.select(F.col("pose_id").alias("pose_b"), F.col("root").alias("rb"), F.col("sequence").alias("sb")), "pose_b")
    qa, qb = g.quaternion(F.col("ra")), g.quaternion(F.col("rb"))
    na, nb = g.without_heading(F.col("ra")), g.without_heading(F.col("rb"))
    turned = F.when(F.col("sa") == F.col("sb"), g.multiply(g.multiply(na, g.inverse(qa)), qb)).otherwise(nb)
    v = g.rotation_vector(g.multiply(turned, g.inverse(na)))
    d = j.select("pair_id", v.alias("v"))
    return rounded(d.select("pair_id", F.degrees("v.x").alias("x"), F.degrees("v.z").alias("y"), (-F.degrees("v.y")).alias("z")), "x", "y", "z")
