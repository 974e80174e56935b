"""The registered queries with the SQL that each must agree with (None: not expressible)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.stages import stored
from ..operators import codes, pairs
from . import catalog
from . import oracle as sql

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, oracle: str | None = None):
    def keep(f: Query) -> Query:
        REGISTRY[name] = (f, oracle)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.pose_view(table(spark, sf_dir, "embeddings"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.working_joints(bodies(spark, sf_dir))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


@query("q_working_joints", f"WITH {sql.POSES} SELECT pose_id, i - 1 AS joint, round(p[i][1], 6) + 0.0 AS x, round(p[i][2], 6) + 0.0 AS y, round(p[i][3], 6) + 0.0 AS z FROM poses, range(1, 36) t(i)")
def working_joints(spark, sf_dir):
    p = poses(spark, sf_dir).select("pose_id", F.posexplode("joints").alias("joint", "p"))
    return rounded(p.select("pose_id", F.col("joint").cast("long").alias("joint"), "p.*"), "x", "y", "z")


@query(
    "q_wrist_calibration",
    f"WITH {sql.POSES} SELECT round(avg(sqrt((p[w][1] - p[f][1]) ** 2 + (p[w][2] - p[f][2]) ** 2 + (p[w][3] - p[f][3]) ** 2)), 6) AS distance FROM poses, (VALUES (21, 23), (22, 24)) t(w, f)",
)
def wrist_calibration(spark, sf_dir):
    """Mean distance between wrist and finger joint over poses and sides."""
    j = lambda n: F.col("joints")[catalog.AT[n]]
    d = F.explode(F.array(*(g.distance(j(f"{s}_wrist"), j(f"{s}_middle2")) for s in catalog.SIDES)))
    return poses(spark, sf_dir).select(d.alias("d")).agg(F.round(F.avg("d"), 6).alias("distance"))


def _kind_query(name: str, kinds: tuple[str, ...]) -> None:
    text = f"WITH {sql.facts(kinds)} SELECT pose_id, code_id, round(value, 6) + 0.0 AS value, intptt_id FROM facts"

    @query(name, text)
    def run(spark, sf_dir):
        return rounded(codes.measure(poses(spark, sf_dir), kinds).select("pose_id", "code_id", "value", "intptt_id"), "value")


for _name, _kinds in {
    "q_angle_codes": ("angle",),
    "q_distance_codes": ("distance",),
    "q_relpos_x": ("relativePosX",),
    "q_relpos_y": ("relativePosY",),
    "q_relpos_z": ("relativePosZ",),
    "q_vaxis_codes": ("relativeVAxis",),
    "q_onground_codes": ("onGround",),
    "q_incline_x": ("bodyInclineX",),
    "q_incline_y": ("bodyInclineY",),
    "q_incline_z": ("bodyInclineZ",),
}.items():
    _kind_query(_name, _kinds)


@query("q_noisy_codes", f"WITH {sql.facts(('angle', 'distance'), 3)} SELECT pose_id, code_id, round(value, 6) + 0.0 AS value, intptt_id FROM facts")
def noisy_codes(spark, sf_dir):
    return rounded(codes.measure(poses(spark, sf_dir), ("angle", "distance"), noise_seed=3).select("pose_id", "code_id", "value", "intptt_id"), "value")


@query("q_code_eligibility", f"WITH {sql.supers()} SELECT pose_id, code_id, intptt_id, elig FROM eligible WHERE elig > 0")
def code_eligibility(spark, sf_dir):
    return codes.eligibility(codes.measure(poses(spark, sf_dir))).where("elig > 0").select("pose_id", "code_id", "intptt_id", "elig")


@query("q_super_codes", f"WITH {sql.supers()} SELECT pose_id, super_id, elig FROM supers")
def super_codes(spark, sf_dir):
    return codes.super_codes(codes.measure(poses(spark, sf_dir)))


@query("q_support_resolution", f"WITH {sql.resolved()} SELECT pose_id, code_id, intptt_id, elig FROM resolved WHERE elig > 0")
def support_resolution(spark, sf_dir):
    facts = codes.measure(poses(spark, sf_dir))
    return codes.resolve_support(codes.eligibility(facts), codes.super_codes(facts)).where("elig > 0").select("pose_id", "code_id", "intptt_id", "elig")


@query(
    "q_super_stats",
    f"""WITH {sql.supers()}, s AS (SELECT super_id, 100.0 * count(*) / (SELECT count(*) FROM poses) AS share FROM supers GROUP BY super_id)
SELECT super_id, round(share, 6) AS share, CASE WHEN share < 6 THEN 'unskippable' WHEN share < 40 THEN 'eligible' ELSE 'ignored' END AS verdict FROM s""",
)
def super_stats(spark, sf_dir):
    p = poses(spark, sf_dir)
    return rounded(codes.super_stats(codes.super_codes(codes.measure(p)), p), "share")


@query(
    "q_code_frequency",
    f"""WITH {sql.facts()}, {sql.code_table()}, s AS (SELECT code_id, intptt_id, count(*) / (SELECT count(*) FROM poses) AS share FROM facts GROUP BY ALL)
SELECT code_id, intptt_id, round(share, 6) AS share, CASE WHEN accepted = 0 THEN 'ignored' WHEN share > 0.4 THEN 'frequent' WHEN share > 0.06 THEN 'usual' ELSE 'rare' END AS verdict
FROM s JOIN code_table USING (code_id, intptt_id)""",
)
def code_frequency(spark, sf_dir):
    p = poses(spark, sf_dir)
    return rounded(codes.code_frequency(codes.measure(p), p), "share")


SEARCHED = [("angle", ("left_shoulder", "left_elbow", "left_wrist"), "completely bent"), ("distance", ("left_hand", "right_hand"), "close")]
_hits = " OR ".join(f"(code_id = {catalog.CODE_ID[k, j]} AND intptt_id = {catalog.OFFSET[k] + catalog.KINDS[k].categories.index(c)})" for k, j, c in SEARCHED)


@query("q_pose_search", f"WITH {sql.facts()} SELECT pose_id FROM facts WHERE {_hits} GROUP BY pose_id HAVING count(DISTINCT code_id) = {len(SEARCHED)}")
def pose_search(spark, sf_dir):
    return codes.search(codes.measure(poses(spark, sf_dir), tuple(dict.fromkeys(k for k, _, _ in SEARCHED)), only=codes.wanted_codes(SEARCHED)), SEARCHED, k=None).select("pose_id")


@query(
    "q_rule_mining",
    f"""WITH {sql.facts()}, {sql.code_table()},
f AS (SELECT pose_id, code_id * 1000 + intptt_id AS item FROM facts JOIN code_table USING (code_id, intptt_id) WHERE accepted = 1),
n AS (SELECT item, count(*) AS n FROM f GROUP BY item HAVING count(*) >= 50)
SELECT x.item AS a, y.item AS b, count(*) AS n, round(count(*) / max(n.n), 6) AS confidence
FROM f x JOIN n ON n.item = x.item JOIN f y ON y.pose_id = x.pose_id AND y.item <> x.item JOIN n m ON m.item = y.item
GROUP BY x.item, y.item HAVING count(*) >= 50 AND count(*) >= 0.7::DOUBLE * max(n.n)""",
)
def rule_mining(spark, sf_dir):
    return rounded(codes.rule_mining(codes.measure(poses(spark, sf_dir))), "confidence")


_mirror = sql.values(codes.mirror_rows())
TRI_SQL = f"""WITH {sql.facts()}, {sql.code_table()}, mir AS (SELECT * FROM {_mirror} t(item, other)),
g AS (SELECT pose_id, code_id * 1000 + intptt_id AS item FROM facts JOIN code_table USING (code_id, intptt_id) WHERE accepted = 1),
i AS (SELECT item, count(*) AS n FROM g GROUP BY item HAVING count(*) >= 50), f AS MATERIALIZED (SELECT pose_id, item FROM g JOIN i USING (item)),
n2 AS MATERIALIZED (SELECT x.item AS a, y.item AS b, count(*) AS n FROM f x JOIN f y ON y.pose_id = x.pose_id AND y.item <> x.item GROUP BY ALL HAVING count(*) >= 50),
bi AS (SELECT a, b AS c FROM n2 JOIN i ON item = a WHERE n2.n >= 0.7::DOUBLE * i.n),
bis AS (SELECT bi.* FROM bi WHERE EXISTS (SELECT 1 FROM bi o JOIN mir x ON x.item = o.a JOIN mir y ON y.item = o.c WHERE x.other = bi.a AND y.other = bi.c)),
t3 AS MATERIALIZED (SELECT p.a, p.b, q.b AS c FROM n2 p JOIN n2 q ON q.a = p.a JOIN n2 r ON r.a = p.b AND r.b = q.b WHERE p.a < p.b AND q.n >= 0.8::DOUBLE * p.n AND r.n >= 0.8::DOUBLE * p.n),
pp AS MATERIALIZED (SELECT x.pose_id, x.item AS a, y.item AS b FROM f x JOIN f y ON y.pose_id = x.pose_id AND y.item > x.item),
m3 AS MATERIALIZED (SELECT pose_id, a, b, c FROM pp JOIN t3 USING (a, b)),
n3 AS (SELECT a, b, c, count(*) AS n FROM m3 JOIN f z ON z.pose_id = m3.pose_id AND z.item = c GROUP BY ALL HAVING count(*) >= 50),
r AS (SELECT n3.a, n3.b, n3.c, n3.n, n3.n / n2.n AS confidence FROM n3 JOIN n2 ON n2.a = n3.a AND n2.b = n3.b WHERE n3.n >= 0.8::DOUBLE * n2.n
  AND NOT EXISTS (SELECT 1 FROM bis WHERE bis.a IN (n3.a, n3.b) AND bis.c = n3.c))
SELECT a, b, c, n, round(confidence, 6) AS confidence FROM r WHERE EXISTS (SELECT 1 FROM r o JOIN mir x ON x.item = o.a JOIN mir y ON y.item = o.b JOIN mir z ON z.item = o.c
  WHERE least(x.other, y.other) = r.a AND greatest(x.other, y.other) = r.b AND z.other = r.c)"""


@query("q_tri_rules", TRI_SQL)
def tri_rules(spark, sf_dir):
    facts = stored(codes.measure(poses(spark, sf_dir)).select("pose_id", "code_id", "intptt_id"), "facts")
    return rounded(codes.tri_rules(facts), "confidence")


@query(
    "q_random_skip",
    f"""WITH {sql.resolved()}, e AS (SELECT pose_id, code_id, intptt_id, elig, elig = 2 OR {sql.uniform_sql(0, 'skip', 'pose_id', 'code_id')} >= 0.15::DOUBLE AS k FROM resolved WHERE elig > 0)
SELECT pose_id, code_id, intptt_id, k OR NOT bool_or(k) OVER (PARTITION BY pose_id) AS kept FROM e""",
)
def random_skip(spark, sf_dir):
    facts = codes.measure(poses(spark, sf_dir))
    return codes.skip(codes.resolve_support(codes.eligibility(facts), codes.super_codes(facts))).select("pose_id", "code_id", "intptt_id", "kept")


PAIR_SETS = {
    "q_pair_angle": ("pair_angle",),
    "q_pair_distance": ("pair_distance",),
    "q_pair_relpos": ("pair_relativePosX", "pair_relativePosY", "pair_relativePosZ"),
    "q_pair_incline": ("pair_bodyInclineX", "pair_bodyInclineY", "pair_bodyInclineZ"),
}
DIFFERENCES = ("pair_angle", "pair_distance")


def pair_facts(spark, sf_dir, kinds: tuple[str, ...]) -> DataFrame:
    p = poses(spark, sf_dir)
    ids, behind = pairs.pairs_of(p), pairs.codes_behind(kinds)
    facts = codes.measure(p, only=behind) if behind else None
    parts = [pairs.change(facts, ids, tuple(k for k in kinds if k in DIFFERENCES))] if set(kinds) & set(DIFFERENCES) else []
    parts += [pairs.moved(p, ids).where(F.col("kind").isin(*kinds))] if any("relativePos" in k for k in kinds) else []
    parts += [pairs.inclined(facts, p, ids)] if any("Incline" in k for k in kinds) else []
    out = parts[0].select("pair_id", "code_id", "kind", "value", "intptt_id")
    for x in parts[1:]:
        out = out.unionByName(x.select(*out.columns))
    return out


def _pair_query(name: str, kinds: tuple[str, ...]) -> None:
    @query(name, f"WITH {sql.pair_facts(kinds)} SELECT pair_id, code_id, round(value, 6) + 0.0 AS value, intptt_id FROM pair_facts")
    def run(spark, sf_dir):
        return rounded(pair_facts(spark, sf_dir, kinds).select("pair_id", "code_id", "value", "intptt_id"), "value")


for _name, _kinds in PAIR_SETS.items():
    _pair_query(_name, _kinds)


@query(
    "q_root_rotation_bins",
    f"""WITH r AS (SELECT vec_id AS pair_id, embedding[64]::DOUBLE * 1000 AS degrees FROM embeddings)
SELECT pair_id, round(degrees, 6) + 0.0 AS degrees, CASE WHEN {sql.bin_sql('degrees', catalog.ROOT_ROTATION.thresholds)} = 8 THEN 0 ELSE {sql.bin_sql('degrees', catalog.ROOT_ROTATION.thresholds)} END AS bin FROM r""",
)
def root_rotation_bins(spark, sf_dir):
    turns = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), (F.col("embedding")[63].cast("double") * 1000).alias("degrees"))
    return rounded(pairs.root_rotation(turns), "degrees")


_REQ = "preq AS (SELECT * FROM " + sql.values(pairs.requirement_rows()) + " t(super_id, way, n_required, role, code_id, wanted))"
_DIRECTION = "CASE " + " ".join(
    f"WHEN f.intptt_id BETWEEN {catalog.PAIR_OFFSET[k]} AND {catalog.PAIR_OFFSET[k] + len(v.categories) - 1} THEN sign(f.intptt_id - {catalog.PAIR_OFFSET[k] + next(i for i, c in enumerate(v.categories) if 'ignored' in c)})"
    for k, v in catalog.PAIR_KINDS.items()
) + " END"


@query(
    "q_super_pair_codes",
    f"""WITH {sql.pair_facts(DIFFERENCES)}, {_REQ},
met AS (
  SELECT pair_id, super_id, way, n_required FROM pairs JOIN facts f ON f.pose_id IN (pose_a, pose_b)
  JOIN preq r ON r.code_id = f.code_id AND r.wanted = f.intptt_id AND ((role = 'a' AND f.pose_id = pose_a) OR (role = 'b' AND f.pose_id = pose_b))
  UNION ALL
  SELECT pair_id, super_id, way, n_required FROM pair_facts f JOIN preq r ON r.code_id = f.code_id
  AND ((role = 'strict' AND f.intptt_id = wanted) OR (role = 'direction' AND {_DIRECTION} = wanted)))
SELECT DISTINCT pair_id, super_id FROM (SELECT pair_id, super_id, way FROM met GROUP BY ALL HAVING count(*) = max(n_required))""",
)
def super_pair_codes(spark, sf_dir):
    p = poses(spark, sf_dir)
    ids, facts = pairs.pairs_of(p), codes.measure(p)
    return pairs.super_pairs(facts, pairs.change(facts, ids, DIFFERENCES), ids)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in REGISTRY.items() if text}
