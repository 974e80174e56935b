"""Queries on metrics and on mining, with their SQL.

Stand-ins: the vectors of a pair's two poses are its query and target features, labels are buckets,
events are the steps of a run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.exprs import uniform_sql
from ..functions.stages import stored
from ..operators import codes, metrics, mining, pairs, text
from . import catalog
from . import oracle as sql
from .queries import bodies, poses, query, rounded, table

DOT = "round(list_dot_product({}::DOUBLE[], {}::DOUBLE[]), 9)"
FEATURES = "q AS (SELECT vec_id // 2 AS id, embedding AS v, label FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT vec_id // 2 AS id, embedding AS v, label FROM embeddings WHERE vec_id % 2 = 1)"


def sides(spark, sf_dir):
    """Features of the first and of the second pose of each pair, by pair id."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("id"), F.col("embedding").alias("v"), "label", (F.col("vec_id") % 2).alias("side"))
    return e.where("side = 0").drop("side"), e.where("side = 1").drop("side")


def _rank_sql(q: str, t: str) -> str:
    return f"SELECT {q}.id, count(*) FILTER ({DOT.format(f'{q}.v', 'x.v')} > own OR ({DOT.format(f'{q}.v', 'x.v')} = own AND x.id < {q}.id)) AS rank FROM (SELECT {q}.*, {DOT.format(f'{q}.v', f'{t}.v')} AS own FROM {q} JOIN {t} USING (id)) {q}, {t} x GROUP BY 1"


@query(
    "q_recall",
    f"""WITH {FEATURES}, r AS (SELECT 'a2b' AS way, * FROM ({_rank_sql('q', 't')}) UNION ALL SELECT 'b2a', * FROM ({_rank_sql('t', 'q')})),
m AS (SELECT way, 'recall_' || k AS metric, avg(CASE WHEN rank < k THEN 100.0::DOUBLE ELSE 0 END) AS value FROM r, (VALUES (1), (5), (10)) x(k) GROUP BY way, k)
SELECT way, metric, round(value, 6) AS value FROM m UNION ALL SELECT 'both', 'mrecall', round(avg(value), 6) FROM m""",
)
def recall(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    out = metrics.recall(metrics.ranks(a, b)).withColumn("way", F.lit("a2b")).unionByName(metrics.recall(metrics.ranks(b, a)).withColumn("way", F.lit("b2a"))).where("metric <> 'mrecall'")
    return rounded(out.unionByName(out.agg(F.avg("value").alias("value")).select("value", F.lit("mrecall").alias("metric"), F.lit("both").alias("way"))), "value")


@query(
    "q_r_precision",
    f"""WITH {FEATURES}, p AS (SELECT q.id, rep, {DOT.format('q.v', 'y.v')} AS own, x.id AS other, {DOT.format('q.v', 'x.v')} AS s,
  row_number() OVER (PARTITION BY q.id, rep ORDER BY {uniform_sql(0, 'pool', 'rep', 'q.id', 'x.id')}, x.id) AS draw
  FROM q JOIN t y ON y.id = q.id JOIN t x ON x.label = q.label AND x.id <> q.id, range(10) r(rep)),
n AS (SELECT id, rep, max(own) AS own, count(*) FILTER (s > own OR (s = own AND other < id)) AS rank FROM p WHERE draw < 32 GROUP BY ALL)
SELECT id, round(avg(rank), 6) AS mean_rank, max(own) AS score FROM n GROUP BY id""",
)
def r_precision(spark, sf_dir):
    """Mean rank of each query's own target over ten pools of 32, and its similarity; both are averaged for the report."""
    a, b = sides(spark, sf_dir)
    return rounded(metrics.r_precision(a, b, "label"), "mean_rank")


PRECISION = f"""WITH {FEATURES}, p AS (SELECT q.id, rep, {DOT.format('q.v', 'y.v')} AS own, x.id AS other, {DOT.format('q.v', 'x.v')} AS s,
  row_number() OVER (PARTITION BY q.id, rep ORDER BY {uniform_sql(0, 'pool', 'rep', 'q.id', 'x.id')}, x.id) AS draw
  FROM q JOIN t y ON y.id = q.id JOIN t x ON x.label = q.label AND x.id <> q.id, range(10) r(rep)),
n AS (SELECT id, rep, max(own) AS own, count(*) FILTER (s > own OR (s = own AND other < id)) AS rank FROM p WHERE draw < 32 GROUP BY ALL),
m AS (SELECT id, avg(rank) AS mean_rank, max(own) AS score FROM n GROUP BY id)
SELECT 'r' || k || '_precision' AS metric, round(avg(CASE WHEN mean_rank < k THEN 100.0::DOUBLE ELSE 0 END), 6) AS value, 100.0::DOUBLE * k / 32 AS random FROM m, (VALUES (1), (2), (3)) t(k) GROUP BY k
UNION ALL SELECT 'score', round(avg(score), 6), NULL FROM m"""


@query("q_top_precision", PRECISION)
def top_precision(spark, sf_dir):
    """Shares of queries whose own target is first, or among the first two or three, of pools of 32 on average."""
    a, b = sides(spark, sf_dir)
    return rounded(metrics.top_precision(metrics.r_precision(a, b, "label")), "value")


_turn = "degrees(2 * acos(greatest(-1.0, least(1.0, abs(x.w * y.w + x.a * y.a + x.b * y.b + x.c * y.c)))))"
CONTROL = f"""WITH {sql.POSES}, {sql.PAIRS}, v AS (SELECT vec_id AS pose_id, j, CASE j WHEN 0 THEN [0.0::DOUBLE, 0.0, 0.0] ELSE [embedding[3 * j - 2]::DOUBLE, embedding[3 * j - 1]::DOUBLE, embedding[3 * j]::DOUBLE] END AS r FROM embeddings, range(22) t(j)),
n AS (SELECT *, sqrt(r[1] * r[1] + r[2] * r[2] + r[3] * r[3]) AS n FROM v), k AS (SELECT *, CASE WHEN n < 1e-12 THEN 0.5 ELSE sin(n / 2) / n END AS k FROM n),
rot AS (SELECT pose_id, j, cos(n / 2) AS w, r[1] * k AS a, r[2] * k AS b, r[3] * k AS c FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id // 32 ORDER BY pair_id) - 1 AS at, count(*) OVER (PARTITION BY pair_id // 32) AS n FROM pairs),
s AS (SELECT x.pair_id, x.pose_a, x.pose_b, y.pose_a AS rand FROM o x JOIN o y ON y.pair_id // 32 = x.pair_id // 32 AND y.at = (x.at + x.n // 2) % x.n),
e AS (SELECT pair_id, 'A' AS w, pose_a AS one, pose_b FROM s UNION ALL SELECT pair_id, 'rand', rand, pose_b FROM s),
jts AS (SELECT e.w, avg(sqrt((x.p[i][1] - y.p[i][1]) ** 2 + (x.p[i][2] - y.p[i][2]) ** 2 + (x.p[i][3] - y.p[i][3]) ** 2)) AS d FROM e JOIN poses x ON x.pose_id = one JOIN poses y ON y.pose_id = e.pose_b, range(1, {len(catalog.JOINTS) + 1}) t(i) GROUP BY e.w),
rots AS (SELECT e.w, avg({_turn}) AS d FROM e JOIN rot x ON x.pose_id = one JOIN rot y ON y.pose_id = e.pose_b AND y.j = x.j GROUP BY e.w)
SELECT 'jts_dist_' || w AS metric, round(d, 6) AS value FROM jts UNION ALL SELECT 'rot_dist_' || w, round(d, 6) FROM rots"""


@query("q_control_measures", CONTROL)
def control_measures(spark, sf_dir):
    """How far pose B is from pose A, and from the A of another pair of its batch of 32: joints and rotations."""
    b, p = bodies(spark, sf_dir), poses(spark, sf_dir)
    r = lambda side: b.select(F.col("pose_id").alias(f"pose_{side}"), F.col("body").alias(f"r{side}"))
    rows = pairs.with_joints(p, pairs.pairs_of(p)).join(r("a"), "pose_a").join(r("b"), "pose_b")
    return rounded(metrics.control_measures(rows.select(F.col("pair_id").alias("id"), F.col("ja").alias("a"), F.col("jb").alias("b"), "ra", "rb"), F.floor(F.col("id") / 32)), "value")


@query(
    "q_joint_distance",
    f"""WITH {sql.POSES}, {sql.PAIRS}, d AS (SELECT pair_id, i - 1 AS joint, sqrt((a.p[i][1] - b.p[i][1]) ** 2 + (a.p[i][2] - b.p[i][2]) ** 2 + (a.p[i][3] - b.p[i][3]) ** 2) AS d
  FROM pairs JOIN poses a ON a.pose_id = pose_a JOIN poses b ON b.pose_id = pose_b, range(1, {len(catalog.JOINTS) + 1}) t(i))
SELECT pair_id, joint, round(d, 6) AS distance, round(avg(d) OVER (PARTITION BY pair_id), 6) AS mean FROM d""",
)
def joint_distance(spark, sf_dir):
    p = poses(spark, sf_dir)
    both = pairs.with_joints(p, pairs.pairs_of(p))
    d = F.zip_with("ja", "jb", g.distance)
    out = both.select("pair_id", F.posexplode(d).alias("joint", "distance"), mining.mpje(F.col("ja"), F.col("jb")).alias("mean"))
    return rounded(out.select("pair_id", F.col("joint").cast("long").alias("joint"), "distance", "mean"), "distance", "mean")


_ROT = "SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS r FROM embeddings"
_QUAT = "SELECT vec_id, cos(n / 2) AS w, r[1] * k AS x, r[2] * k AS y, r[3] * k AS z FROM (SELECT *, CASE WHEN n < 1e-12 THEN 0.5 ELSE sin(n / 2) / n END AS k FROM (SELECT *, sqrt(r[1] ** 2 + r[2] ** 2 + r[3] ** 2) AS n FROM rot))"


@query(
    "q_geodesic",
    f"""WITH rot AS ({_ROT}), quat AS ({_QUAT}), {sql.PAIRS}
SELECT pair_id, round(degrees(2 * acos(least(1.0, abs(a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z)))), 6) + 0.0 AS degrees FROM pairs JOIN quat a ON a.vec_id = pose_a JOIN quat b ON b.vec_id = pose_b""",
)
def geodesic(spark, sf_dir):
    b = bodies(spark, sf_dir).select("pose_id", g.quaternion(F.col("body")[1]).alias("q"))
    ids = pairs.pairs_of(b)
    j = ids.join(b.select(F.col("pose_id").alias("pose_a"), F.col("q").alias("qa")), "pose_a").join(b.select(F.col("pose_id").alias("pose_b"), F.col("q").alias("qb")), "pose_b")
    return rounded(j.select("pair_id", metrics.geodesic(F.col("qa"), F.col("qb")).alias("degrees")), "degrees")


@query(
    "q_best_of_samples",
    """WITH s AS (SELECT user_id AS data_id, event_id AS sample_idx, abs(value) AS value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY value, sample_idx) AS r FROM s)
SELECT data_id, round(avg(value), 6) AS "all", round(avg(value) FILTER (r <= 1), 6) AS top_1, round(avg(value) FILTER (r <= 6), 6) AS top_6 FROM r GROUP BY data_id""",
)
def best_of_samples(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("data_id"), F.col("event_id").alias("sample_idx"), F.abs("value").alias("value"))
    return rounded(metrics.best_of(s), "all", "top_1", "top_6")


_E = "[embedding[i]::DOUBLE FOR i IN range({}, {})]"


@query(
    "q_elbo_terms",
    """WITH v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS m1, exp(embedding[i + 16]::DOUBLE) AS s1, embedding[i + 32]::DOUBLE AS m2, exp(embedding[i + 48]::DOUBLE) AS s2 FROM embeddings, range(1, 17) t(i))
SELECT vec_id, round(sum(ln(s2 / s1) + (s1 * s1 + (m1 - m2) ** 2) / (2 * s2 * s2) - 0.5) / 16, 6) AS kl, round(-sum(abs(m1 - m2) / 0.5 + ln(2 * 0.5)) / 16, 6) + 0.0 AS laplace,
  round(-sum((m1 - m2) ** 2 / (2 * 0.25) + ln(0.5) + 0.5 * ln(2 * pi())) / 16, 6) + 0.0 AS gaussian FROM v GROUP BY vec_id""",
)
def elbo_terms(spark, sf_dir):
    """Log likelihoods and divergence of each vector's quarters (means, log deviations, other means, other log deviations), by coefficient."""
    part = lambda n: F.transform(F.slice("embedding", 16 * n + 1, 16), lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(part(n).alias(f"p{n}") for n in range(4)))
    m1, m2 = F.col("p0"), F.col("p2")
    s1, s2 = (F.transform(c, F.exp) for c in ("p1", "p3"))
    out = e.select("vec_id", (metrics.kl(m1, s1, m2, s2) / 16).alias("kl"), (-metrics.laplace_nll(m1, m2, 0.5) / 16).alias("laplace"), (-metrics.gaussian_nll(m1, m2, 0.5) / 16).alias("gaussian"))
    return rounded(out, "kl", "laplace", "gaussian")


@query(
    "q_feature_moments",
    """WITH v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i))
SELECT a.label, a.i - 1 AS i, b.i - 1 AS j, round(avg(a.x), 6) + 0.0 AS mean_i, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""",
)
def feature_moments(spark, sf_dir):
    """What the distance of two feature distributions is made from."""
    f = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = metrics.moments(f, "label")
    return rounded(out.select("label", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "mean_i", "cov"), "mean_i", "cov")


@query(
    "q_contrastive_loss",
    f"""WITH {FEATURES}, s AS (SELECT q.id // 32 AS batch, q.id AS q, t.id AS t, {DOT.format('q.v', 't.v')} AS s FROM q JOIN t ON q.id // 32 = t.id // 32),
x AS (SELECT batch, q AS own_id, ln(sum(exp(s))) - max(s) FILTER (q = t) AS l FROM s GROUP BY batch, q), y AS (SELECT batch, t, ln(sum(exp(s))) - max(s) FILTER (q = t) AS l FROM s GROUP BY batch, t)
SELECT batch, round(((SELECT avg(l) FROM x WHERE x.batch = b.batch) + (SELECT avg(l) FROM y WHERE y.batch = b.batch)) / 2, 6) AS loss FROM (SELECT DISTINCT batch FROM s) b""",
)
def contrastive_loss(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    batch = F.floor(F.col("id") / 32)
    q, t = a.select(F.col("id").alias("q"), F.col("v").alias("vq"), batch.alias("batch")), b.select(F.col("id").alias("t"), F.col("v").alias("vt"), batch.alias("batch"))
    s = q.join(t, "batch").select("batch", "q", "t", F.round(mining.dot(F.col("vq"), F.col("vt")), 9).alias("s"))
    return rounded(metrics.contrastive(s), "loss")


_GRAMS = "SELECT id, n, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS gram FROM {}, range(1, 5) a(n), range(1, 400) b(i) WHERE i + n - 1 <= len(ws)"
WORDS = r"regexp_extract_all(lower(text), '[a-z]+')"


@query(
    "q_bleu",
    f"""WITH c AS (SELECT conv_id AS id, {WORDS} AS ws FROM conversations WHERE turn = 0 AND conv_id IN (SELECT item_id FROM benchmark)), r AS (SELECT item_id AS id, {WORDS} AS ws FROM benchmark WHERE item_id IN (SELECT id FROM c)),
cg AS (SELECT id, n, gram, count(*) AS k FROM ({_GRAMS.format('c')}) GROUP BY ALL), rg AS (SELECT id, n, gram, count(*) AS m FROM ({_GRAMS.format('r')}) GROUP BY ALL),
p AS (SELECT n, sum(least(k, coalesce(m, 0))) AS hit, sum(k) AS total FROM cg LEFT JOIN rg USING (id, n, gram) GROUP BY n),
l AS (SELECT (SELECT sum(len(ws)) FROM c) AS cl, (SELECT sum(len(ws)) FROM r) AS rl)
SELECT round(exp(least(0.0, 1 - rl / cl) + (SELECT CASE WHEN count(*) = 4 AND min(hit) > 0 THEN sum(ln(hit / total)) / 4 ELSE '-inf'::DOUBLE END FROM p)), 6) AS bleu FROM l""",
)
def bleu(spark, sf_dir):
    ws = lambda: F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws")
    c = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), ws())
    r = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), ws())
    return rounded(metrics.bleu(c.join(r, "id", "left_semi"), r.join(c, "id", "left_semi")), "bleu")


@query("q_rouge_l")
def rouge(spark, sf_dir):
    ws = lambda name: F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias(name)
    c = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), ws("a"))
    r = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), ws("b"))
    return rounded(c.join(r, "id").select("id", metrics.rouge_l(F.col("a"), F.col("b")).alias("rouge")), "rouge")


@query("q_likelihood", "SELECT user_id AS id, round(sum(-abs(value)) / count(value), 6) + 0.0 AS score FROM events GROUP BY user_id")
def likelihood(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (-F.abs("value")).alias("logp"))
    return rounded(metrics.likelihood(t), "score")


@query("q_run_statistics", "WITH r AS (SELECT event_type AS name, user_id AS run, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM r GROUP BY name")
def run_statistics(spark, sf_dir):
    """Values are averaged within a run (nulls skipped), then over the runs."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("run"), "value")
    return rounded(metrics.runs(metrics.meters(e, "name", "run")), "mean", "std")


@query(
    "q_smoothed",
    """WITH e AS (SELECT user_id AS name, event_id AS step, ln(1 + abs(value)) AS value FROM events WHERE value IS NOT NULL)
SELECT name, step, round(value, 6) + 0.0 AS value, round(list_sort(list(value) OVER w)[(len(list(value) OVER w) + 1) // 2], 6) + 0.0 AS median, round(avg(value) OVER w, 6) + 0.0 AS avg, round(max(value) OVER w, 6) + 0.0 AS max,
  round(last_value(value) OVER w, 6) + 0.0 AS last, round(avg(value) OVER g, 6) + 0.0 AS global_avg
FROM e WINDOW w AS (PARTITION BY name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def smoothed(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("name"), F.col("event_id").alias("step"), F.log(1 + F.abs("value")).alias("value"))
    return rounded(metrics.smoothed(e), "value", "median", "avg", "max", "last", "global_avg")


@query(
    "q_best_so_far",
    """WITH e AS (SELECT user_id AS name, event_id AS step, value FROM events WHERE value IS NOT NULL),
m AS (SELECT name, step, value, max(value) OVER w AS hi, min(value) OVER w AS lo FROM e WINDOW w AS (PARTITION BY name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT name, step, hi IS NULL OR value > hi AS best, lo IS NULL OR value < lo AS least FROM m""",
)
def best_so_far(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("name"), F.col("event_id").alias("step"), "value")
    return metrics.best_so_far(e).select("name", "step", "best", "least")


@query(
    "q_control_pairs",
    """WITH r AS (SELECT vec_id AS id, label AS batch, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT a.id, b.id AS half, c.id AS next FROM r a JOIN r b ON a.batch = b.batch AND b.k = (a.k + a.n // 2) % a.n JOIN r c ON a.batch = c.batch AND c.k = (a.k + 1) % a.n""",
)
def control_pairs(spark, sf_dir):
    """Random controls: of each row the one half a batch further on, and the next one, around the end."""
    r = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("batch"))
    return metrics.shifted(r).withColumnRenamed("partner", "half").join(metrics.shifted(r, 1).withColumnRenamed("partner", "next"), "id")


# Mining: frames are events, ten to a second.
FRAMES = "f AS (SELECT event_id AS id, user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events), x AS (SELECT *, frame / 10.0::DOUBLE AS t FROM f)"


def mining_frames(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("sequence"), F.row_number().over(w).alias("frame")).withColumn("t", F.col("frame") / 10.0)


@query("q_in_sequence_pairs", f"WITH {FRAMES} SELECT a.id AS a, b.id AS b, b.frame - a.frame AS frame_diff FROM x a JOIN x b ON a.seq = b.seq AND b.frame > a.frame AND b.t - a.t < 0.5")
def in_sequence_pairs(spark, sf_dir):
    return mining.in_sequence(mining_frames(spark, sf_dir))


#: Similarities that are near but not too near, for the features of the tables.
NEAR, SAME = 0.3, 0.9
SIMILAR = f"""s AS (SELECT b.vec_id AS b, a.vec_id AS a, round(list_dot_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) * sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))), 6) AS similarity
  FROM embeddings b JOIN embeddings a ON a.label <> b.label AND a.vec_id <> b.vec_id),
similar_ AS (SELECT b, a, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY similarity DESC, a) AS rank FROM s) WHERE rank <= 100 AND similarity > {NEAR} AND similarity < {SAME})"""


@query("q_similar_pairs", f"WITH {SIMILAR} SELECT b, a, similarity, rank FROM similar_")
def similar_pairs(spark, sf_dir):
    """Of the hundred features of other sequences that are most similar to each one, those that aren't too similar."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    n = F.sqrt(mining.dot(F.col("v"), F.col("v")))
    return mining.similar(e.select("id", F.transform("v", lambda x: x / n).alias("v"), "label"), 100, NEAR, SAME, "label")


@query(
    "q_code_difference",
    f"""WITH {sql.facts()}, {sql.PAIRS} SELECT pose_a AS a, pose_b AS b, sum(CASE WHEN x.intptt_id <> y.intptt_id THEN 1 ELSE 0 END) AS n_diff FROM pairs JOIN facts x ON x.pose_id = pose_a JOIN facts y ON y.pose_id = pose_b AND y.code_id = x.code_id
GROUP BY ALL HAVING sum(CASE WHEN x.intptt_id <> y.intptt_id THEN 1 ELSE 0 END) > 15""",
)
def code_difference(spark, sf_dir):
    p = poses(spark, sf_dir)
    ids = pairs.pairs_of(p).select(F.col("pose_a").alias("a"), F.col("pose_b").alias("b"))
    return mining.code_difference(codes.measure(p), ids, 15)


#: Candidate pairs of events of one user, by how near their values are.
CANDIDATES = f"{FRAMES}, c AS (SELECT a.id AS a, b.id AS b, b.frame - a.frame AS frame_diff, 1 - (b.frame - a.frame) / 10.0::DOUBLE AS similarity FROM x a JOIN x b ON a.seq = b.seq AND b.frame > a.frame AND b.t - a.t < 0.5)"


def candidates(spark, sf_dir):
    return mining.in_sequence(mining_frames(spark, sf_dir)).withColumn("similarity", 1 - F.col("frame_diff") / 10.0)


@query(
    "q_window_keep",
    f"""WITH {CANDIDATES}, w AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY similarity DESC, a) AS rank FROM c), t AS (SELECT *, count(*) OVER (PARTITION BY b) AS n, row_number() OVER (PARTITION BY b ORDER BY {uniform_sql(0, 'window', 'a', 'b')}, a) AS draw FROM w WHERE rank <= 3)
SELECT a, b, rank, n < 2 AS short FROM t WHERE draw <= 2""",
)
def window_keep(spark, sf_dir):
    return mining.window_keep(candidates(spark, sf_dir), 3, 2)


ONCE = f"""{CANDIDATES}, o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY b ORDER BY frame_diff, a) = 1), u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY a ORDER BY frame_diff, b) = 1)"""


@query("q_role_unicity", f"WITH {ONCE} SELECT a, b, frame_diff FROM u")
def role_unicity(spark, sf_dir):
    return mining.role_unicity(candidates(spark, sf_dir)).select("a", "b", "frame_diff")


ANNOTATED = f"""RECURSIVE {SIMILAR}, u AS (SELECT a, count(*) AS uses FROM similar_ GROUP BY a),
w AS (SELECT b, a, -ln(1 - {uniform_sql(0, 'annotate', 'b', 'a')}) * uses AS wait, a > b AND a IN (SELECT b FROM similar_) AS later FROM similar_ JOIN u USING (a)),
p AS (SELECT b, list(a ORDER BY wait, a) AS choices, list(a ORDER BY wait, a) FILTER (later) AS ahead FROM w GROUP BY b),
q AS (SELECT *, row_number() OVER (ORDER BY b) AS k FROM p),
rec AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS gone, NULL::BIGINT AS b, NULL::BIGINT AS a, false AS two_way
  UNION ALL
  SELECT q.k, CASE WHEN list_contains(gone, q.b) OR x.a IS NULL THEN gone ELSE list_append(gone, x.a) END, CASE WHEN NOT list_contains(gone, q.b) THEN q.b END, coalesce(x.a, choices[1]), x.a IS NOT NULL
  FROM rec JOIN q ON q.k = rec.k + 1, LATERAL (SELECT [i FOR i IN q.ahead IF NOT list_contains(rec.gone, i)][1] AS a) x),
steps AS (SELECT b AS turn, b, a, two_way, 0 AS step FROM rec WHERE b IS NOT NULL UNION ALL SELECT b, a, b, two_way, 1 FROM rec WHERE b IS NOT NULL AND two_way)"""


@query("q_annotation_order", f"WITH {ANNOTATED} SELECT b, a, two_way, step, row_number() OVER (ORDER BY turn, step) - 1 AS place FROM steps")
def annotation_order(spark, sf_dir):
    """The similar pairs of different sequences in the order in which they would be annotated, both ways where that can be."""
    out = mining.annotation_order(similar_pairs(spark, sf_dir).select("a", "b"))
    return out.select("b", "a", "two_way", F.col("step").cast("long").alias("step"), F.col("place").cast("long").alias("place"))


@query("q_sequence_order", f"WITH {CANDIDATES} SELECT a, b, row_number() OVER (ORDER BY b, a) - 1 AS place FROM c")
def sequence_order(spark, sf_dir):
    """The pairs of one sequence in the order in which they would be annotated."""
    return mining.in_order(candidates(spark, sf_dir)).select("a", "b", F.col("place").cast("long").alias("place"))


@query("q_nearest", f"SELECT id, similarity FROM (SELECT vec_id AS id, {DOT.format('embedding', '(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)')} AS similarity FROM embeddings) ORDER BY similarity DESC, id LIMIT 12")
def nearest(spark, sf_dir):
    """The twelve rows most similar to the first one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return mining.nearest(e, e.orderBy("id").limit(1))


@query("q_farthest")
def farthest(spark, sf_dir):
    """The first twenty poses of the diversity order."""
    return mining.farthest(poses(spark, sf_dir), 20)


#: What stands for a model's pose B under each setting: pose A itself, A and the pose after it, a pose that the text alone decides, A and B.
SETTINGS_SQL = f"""WITH {sql.POSES}, {sql.PAIRS}, e AS (SELECT vec_id AS pose_id, label FROM embeddings), m AS (SELECT count(*) AS m FROM pairs), pk AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS k FROM pairs),
base AS (
  SELECT pk.pair_id, k, a.p AS pa, b.p AS pb, ea.label = eb.label AS same, l.doc_id IS NOT NULL AS shared, coalesce(l.quality, 0) = 1 AS described
  FROM pk JOIN poses a ON a.pose_id = pose_a JOIN poses b ON b.pose_id = pose_b JOIN e ea ON ea.pose_id = pose_a JOIN e eb ON eb.pose_id = pose_b LEFT JOIN labels l ON l.doc_id = pose_b),
nxt AS (SELECT x.pair_id, y.pb AS other, z.pa AS after FROM base x, m JOIN base y ON y.k = (x.k * 7 + 3) % m JOIN base z ON z.k = (x.k + 1) % m),
lay AS (
  SELECT pair_id, s, j, pb[j] AS b, CASE s WHEN 'pose_similarity' THEN pa[j] WHEN 'pose_only' THEN [(pa[j][c] + after[j][c]) / 2 FOR c IN [1, 2, 3]] WHEN 'text_only' THEN other[j] ELSE [(pa[j][c] + pb[j][c]) / 2 FOR c IN [1, 2, 3]] END AS g
  FROM base JOIN nxt USING (pair_id), (VALUES ('pose_similarity'), ('pose_only'), ('text_only'), ('regular')) t(s), range(1, {len(catalog.JOINTS) + 1}) r(j)),
d AS (SELECT pair_id, s AS setting, avg(sqrt((g[1] - b[1]) ** 2 + (g[2] - b[2]) ** 2 + (g[3] - b[3]) ** 2)) AS mpje, max(sqrt((g[1] - b[1]) ** 2 + (g[2] - b[2]) ** 2 + (g[3] - b[3]) ** 2)) AS worst FROM lay GROUP BY ALL),
sets AS (SELECT pair_id, unnest(['all', CASE WHEN same THEN 'in-sequence' ELSE 'out-sequence' END, CASE WHEN shared THEN 'shared' END, CASE WHEN shared AND NOT described THEN 'shared, modifier only' END, CASE WHEN shared AND described THEN 'shared, description only' END]) AS subset FROM base)
SELECT setting, subset, count(*) AS n_data, round(avg(mpje), 6) AS mpje, round(avg(worst), 6) AS worst FROM d JOIN sets USING (pair_id) WHERE subset IS NOT NULL GROUP BY ALL"""


@query("q_settings", SETTINGS_SQL)
def settings(spark, sf_dir):
    """Four ways to ask for pose B on six subsets of the pairs, in one pass."""
    p = poses(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    label = lambda side: e.select(F.col("vec_id").alias(f"pose_{side}"), F.col("label").alias(f"label_{side}"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pose_b"), F.lit(True).alias("shared"), (F.coalesce("quality", F.lit(0)) == 1).alias("described"))
    base = pairs.with_joints(p, pairs.pairs_of(p)).join(label("a"), "pose_a").join(label("b"), "pose_b").join(known, "pose_b", "left")
    at = text.in_order(base.select("pair_id"), "pair_id").withColumnRenamed("place", "k")
    base = stored(base.join(at, "pair_id"), "base")
    at = at.crossJoin(F.broadcast(at.agg(F.count("*").alias("m")))).select("pair_id", ((F.col("k") * 7 + 3) % F.col("m")).alias("k_other"), ((F.col("k") + 1) % F.col("m")).alias("k_after"))
    rows = base.join(at, "pair_id").join(base.select(F.col("k").alias("k_other"), F.col("jb").alias("other")), "k_other").join(base.select(F.col("k").alias("k_after"), F.col("ja").alias("after")), "k_after")
    middle = lambda x, y: F.zip_with(x, y, lambda p, q: g.mean(p, q))
    given = {"pose_similarity": F.col("ja"), "pose_only": middle("ja", "after"), "text_only": F.col("other"), "regular": middle("ja", "jb")}
    same, shared, described = F.col("label_a") == F.col("label_b"), F.coalesce("shared", F.lit(False)), F.coalesce("described", F.lit(False))
    sets = {"all": F.lit(True), "in-sequence": same, "out-sequence": ~same, "shared": shared, "shared, modifier only": shared & ~described, "shared, description only": shared & described}
    out = metrics.by_setting(rows, given, sets, lambda x: {"mpje": mining.mpje(x, F.col("jb")), "worst": F.array_max(F.zip_with(x, "jb", g.distance))})
    return rounded(out, "mpje", "worst")
