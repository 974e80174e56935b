"""Queries of the pair pipeline: eligibility, supports, merging, search and head rotation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.stages import stored
from ..operators import codes, pairs, rewrite
from . import catalog
from . import oracle as sql
from .catalog import PAIR_CODES, PAIR_KINDS
from .queries import _DIRECTION, _REQ, DIFFERENCES, bodies, pair_facts, poses, query, rounded

ALL = tuple(k for k in PAIR_KINDS if not k.startswith("pair_relativeRot"))


def _code_rows() -> list[tuple]:
    rows = []
    for i, c in enumerate(PAIR_CODES):
        names = PAIR_KINDS[c.kind].categories
        middle = next(n for n, x in enumerate(names) if "ignored" in x)
        first = c.focus or c.joints[0]
        second = next((j for j in c.joints[::-1] if j != first), None) if c.kind == "pair_distance" else None
        rows += [
            (i, catalog.PAIR_OFFSET[c.kind] + n, int(x in c.accepted) + int(x in c.rare), *catalog.split_side(first), *catalog.split_side(second), c.kind, (n > middle) - (n < middle), abs(n - middle))
            for n, x in enumerate(names)
        ]
    return rows


TABLE = f"pair_table AS (SELECT * FROM {sql.values(_code_rows())} t(code_id, intptt_id, elig, side1, part1, side2, part2, nature, direction, magnitude))"
FIRED = f"""{sql.pair_facts(ALL)}, {_REQ}, {TABLE},
met AS (
  SELECT pair_id, super_id, way, n_required FROM pairs JOIN facts f ON f.pose_id IN (pose_a, pose_b)
  JOIN preq r ON r.code_id = f.code_id AND r.wanted = f.intptt_id AND ((role = 'a' AND f.pose_id = pose_a) OR (role = 'b' AND f.pose_id = pose_b))
  UNION ALL
  SELECT pair_id, super_id, way, n_required FROM pair_facts f JOIN preq r ON r.code_id = f.code_id
  AND ((role = 'strict' AND f.intptt_id = wanted) OR (role = 'direction' AND {_DIRECTION} = wanted))),
fired AS (SELECT DISTINCT pair_id, super_id FROM (SELECT pair_id, super_id, way FROM met GROUP BY ALL HAVING count(*) = max(n_required)))"""
# moves of pairs of joints (distance) only exist for super-codes; more or less bending gives way to the super-code it makes
GONE = f"""kinds AS (SELECT DISTINCT super_id, r.code_id, t.intptt_id, nature FROM preq r JOIN pair_table t ON t.code_id = r.code_id AND ((role = 'strict' AND t.intptt_id = wanted) OR (role = 'direction' AND t.direction = wanted))),
settled AS (SELECT f.pair_id, f.code_id, f.intptt_id, CASE WHEN EXISTS (SELECT 1 FROM kinds k WHERE k.nature = 'pair_distance' AND k.code_id = f.code_id AND k.intptt_id = f.intptt_id)
    OR EXISTS (SELECT 1 FROM kinds k JOIN fired x USING (super_id) WHERE k.nature = 'pair_angle' AND x.pair_id = f.pair_id AND k.code_id = f.code_id AND k.intptt_id = f.intptt_id) THEN 0 ELSE t.elig END AS elig
  FROM pair_facts f JOIN pair_table t USING (code_id, intptt_id))"""


def measured(spark, sf_dir):
    """Poses, pairs, pose facts, pair facts and the super-pair-codes that hold."""
    p = poses(spark, sf_dir)
    ids = pairs.pairs_of(p)
    facts = stored(codes.measure(p), "facts")
    changes = stored(pair_facts(spark, sf_dir, ALL), "changes")
    return ids, facts, changes, pairs.super_pairs(facts, changes.where(F.col("kind").isin(*DIFFERENCES)), ids)


@query("q_pair_eligibility", f"WITH {sql.pair_facts(ALL)}, {TABLE} SELECT pair_id, code_id, intptt_id, elig FROM pair_facts JOIN pair_table USING (code_id, intptt_id) WHERE elig > 0")
def pair_eligibility(spark, sf_dir):
    return pairs.pair_eligibility(pair_facts(spark, sf_dir, ALL)).where("elig > 0").select("pair_id", "code_id", "intptt_id", "elig")


@query("q_absolute_eligibility", f"WITH {sql.facts()}, {sql.code_table()} SELECT pose_id, code_id, intptt_id, CASE WHEN rare = 1 THEN 2 ELSE 1 END AS elig FROM facts JOIN code_table USING (code_id, intptt_id) WHERE absolute = 1")
def absolute_eligibility(spark, sf_dir):
    return pairs.absolute_eligibility(codes.measure(poses(spark, sf_dir))).where("elig > 0").select("pose_id", "code_id", "intptt_id", "elig")


@query("q_pair_support", f"WITH {FIRED}, {GONE} SELECT pair_id, code_id, intptt_id, elig FROM settled WHERE elig > 0")
def pair_support(spark, sf_dir):
    _, _, changes, supers = measured(spark, sf_dir)
    return pairs.resolve_pair_support(pairs.pair_eligibility(changes), supers).where("elig > 0").select("pair_id", "code_id", "intptt_id", "elig")


@query(
    "q_pair_pose_support",
    f"""WITH {FIRED}, {sql.code_table()}, gone AS (SELECT DISTINCT CASE role WHEN 'a' THEN pose_a ELSE pose_b END AS pose_id, code_id, wanted AS intptt_id FROM fired JOIN pairs USING (pair_id) JOIN preq r USING (super_id) WHERE role IN ('a', 'b'))
SELECT pose_id, code_id, intptt_id, CASE WHEN rare = 1 THEN 2 ELSE 1 END AS elig FROM facts f JOIN code_table USING (code_id, intptt_id) WHERE absolute = 1 AND NOT EXISTS (SELECT 1 FROM gone x WHERE x.pose_id = f.pose_id AND x.code_id = f.code_id AND x.intptt_id = f.intptt_id)""",
)
def pair_pose_support(spark, sf_dir):
    ids, facts, _, supers = measured(spark, sf_dir)
    return pairs.resolve_pose_support(pairs.absolute_eligibility(facts), supers, ids).where("elig > 0").select("pose_id", "code_id", "intptt_id", "elig")


_ent = sql.values([*rewrite.ENTITIES, *((y, x, e) for x, y, e in rewrite.ENTITIES)])


@query(
    "q_pair_entity_merge",
    f"""WITH {FIRED}, {GONE}, ent AS (SELECT * FROM {_ent} t(x, y, entity)),
rows AS (SELECT pair_id, code_id, side1, part1, intptt_id, nature, direction, magnitude, side2, part2 FROM settled s JOIN pair_table t USING (code_id, intptt_id) WHERE s.elig > 0),
both_ AS (SELECT a.pair_id, a.code_id AS ca, b.code_id AS cb, a.side1, coalesce(t.entity, b.part1) AS m1, a.nature, a.direction, a.side2, coalesce(u.entity, b.part2) AS m2, greatest(a.magnitude, b.magnitude) AS m, CASE WHEN b.magnitude > a.magnitude THEN b.intptt_id ELSE a.intptt_id END AS i
  FROM rows a JOIN rows b ON b.pair_id = a.pair_id AND b.code_id > a.code_id AND b.side1 IS NOT DISTINCT FROM a.side1 AND b.nature = a.nature AND b.direction = a.direction AND b.side2 IS NOT DISTINCT FROM a.side2
  LEFT JOIN ent t ON a.part1 = t.x AND b.part1 = t.y LEFT JOIN ent u ON a.part2 = u.x AND b.part2 = u.y
  WHERE (t.entity IS NOT NULL AND (u.entity IS NOT NULL OR a.part2 IS NOT DISTINCT FROM b.part2)) OR (u.entity IS NOT NULL AND a.part1 = b.part1))
SELECT DISTINCT pair_id, side1, part1, intptt_id, side2, part2 FROM rows r WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.pair_id = r.pair_id AND r.code_id IN (ca, cb))
UNION SELECT pair_id, side1, m1, max((m, i))[2], side2, m2 FROM both_ GROUP BY pair_id, side1, m1, nature, direction, side2, m2""",
)
def pair_entity_merge(spark, sf_dir):
    _, _, changes, supers = measured(spark, sf_dir)
    return pairs.merge_entities(pairs.formatted(pairs.resolve_pair_support(pairs.pair_eligibility(changes), supers)), rewrite.ENTITIES)


@query(
    "q_pair_fusion",
    f"""WITH {sql.pair_facts(ALL)}, {TABLE}, r AS (SELECT pair_id AS pose_id, nature = 'pair_distance' AS off, intptt_id || '|' || coalesce(side2, '') || '|' || coalesce(part2, '') AS pred, coalesce(side1, '') || '|' || part1 AS subj
  FROM pair_facts JOIN pair_table USING (code_id, intptt_id) WHERE elig > 0),
n AS (SELECT *, count(*) FILTER (NOT off) OVER (PARTITION BY pose_id, pred) AS np, count(*) FILTER (NOT off) OVER (PARTITION BY pose_id, subj) AS ns FROM r),
h AS (SELECT *, CASE WHEN off THEN 'alone' WHEN np > 1 AND np >= ns THEN 'predicate' WHEN ns > 1 THEN 'subject' ELSE 'alone' END AS how FROM n)
SELECT pose_id AS pair_id, how, CASE how WHEN 'predicate' THEN pred WHEN 'subject' THEN subj ELSE subj || '#' || pred END AS key, count(*) AS n FROM h GROUP BY ALL""",
)
def pair_fusion(spark, sf_dir):
    """Distances between parts of a pair are never fused."""
    rows = pairs.formatted(pairs.pair_eligibility(stored(pair_facts(spark, sf_dir, ALL), "changes")))
    kind = PAIR_KINDS["pair_distance"].categories
    first = catalog.PAIR_OFFSET["pair_distance"]
    rows = rows.select(F.col("pair_id").alias("pose_id"), "side1", "part1", F.col("intptt_id").cast("string").alias("intptt"), "side2", "part2", F.col("intptt_id").between(first, first + len(kind) - 1).alias("distance"))
    return rewrite.fuse(rows, F.col("distance")).withColumnRenamed("pose_id", "pair_id")


WANTED = [("pair_angle", ("left_shoulder", "left_elbow", "left_wrist"), "bent much more"), ("pair_relativePosY", ("left_hand",) * 2, "higher")]
_hits = " OR ".join(f"(code_id = {catalog.PAIR_CODE_ID[k, j]} AND intptt_id = {catalog.PAIR_OFFSET[k] + PAIR_KINDS[k].categories.index(c)})" for k, j, c in WANTED)


@query("q_pair_search", f"WITH {sql.pair_facts(tuple(k for k, _, _ in WANTED))} SELECT pair_id FROM pair_facts WHERE {_hits} GROUP BY pair_id HAVING count(DISTINCT code_id) = {len(WANTED)}")
def pair_search(spark, sf_dir):
    return pairs.search(pair_facts(spark, sf_dir, tuple(k for k, _, _ in WANTED)), WANTED)


def _chain_sql(name: str, joints: list[int]) -> str:
    """CTEs up to `name` (pose_id, w, x, y, z): the rotations of a chain of joints applied one in another."""
    out, before = [], None
    for n, j in enumerate(joints):
        v = ["0.0::DOUBLE"] * 3 if j == 0 else [f"embedding[{3 * (j - 1) + k}]::DOUBLE" for k in (1, 2, 3)]
        r, q = f"{name}_r{n}", f"{name}_q{n}"
        out.append(f"{r} AS (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (SELECT vec_id AS pose_id, {v[0]} AS a, {v[1]} AS b, {v[2]} AS c FROM embeddings))")
        out.append(f"{q} AS (SELECT pose_id, cos(n / 2) AS w, a * k AS x, b * k AS y, c * k AS z FROM (SELECT *, CASE WHEN n < 1e-12 THEN 0.5 ELSE sin(n / 2) / n END AS k FROM {r}))")
        if before:
            p = f"{name}_p{n}"
            out.append(
                f"{p} AS (SELECT pose_id, p.w * q.w - p.x * q.x - p.y * q.y - p.z * q.z AS w, p.w * q.x + p.x * q.w + p.y * q.z - p.z * q.y AS x, p.w * q.y - p.x * q.z + p.y * q.w + p.z * q.x AS y, "
                f"p.w * q.z + p.x * q.y - p.y * q.x + p.z * q.w AS z FROM {before} p JOIN {q} q USING (pose_id))"
            )
            q = p
        before = q
    return ", ".join(out) + f", {name} AS (SELECT * FROM {before})"


_EULER = {
    "X": "degrees(atan2(2 * (y * z + w * x), 1 - 2 * (x * x + y * y)))",
    "Y": "degrees(atan2(-2 * (x * z - w * y), sqrt(pow(2 * (y * z + w * x), 2) + pow(1 - 2 * (x * x + y * y), 2))))",
    "Z": "degrees(atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z)))",
}


def _rotations() -> str:
    """CTEs up to `turned` (pose_id, code_id, kind, value, intptt_id)."""
    parts, rows = [], []
    for axis in "XYZ":
        kind = f"relativeRot{axis}"
        i, c = next((i, c) for i, c in enumerate(catalog.CODES) if c.kind == kind)
        parts.append(_chain_sql(f"rot{axis}", g.chain_between(*c.joints)))
        rows.append(f"SELECT pose_id, {i} AS code_id, '{kind}' AS kind, value, {sql.bin_sql('value', catalog.KINDS[kind].thresholds)} + {catalog.OFFSET[kind]} AS intptt_id FROM (SELECT pose_id, {_EULER[axis]} + 0.0 AS value FROM rot{axis})")
    return ", ".join(parts) + f", turned AS ({' UNION ALL '.join(rows)})"


ROTATIONS = _rotations()


@query("q_relative_rotation", f"WITH {ROTATIONS} SELECT pose_id, code_id, round(value, 6) + 0.0 AS value, intptt_id FROM turned")
def relative_rotation(spark, sf_dir):
    return rounded(codes.measure_rotations(bodies(spark, sf_dir)).select("pose_id", "code_id", "value", "intptt_id"), "value")


_turns = [(i, c.kind, catalog.CODE_ID[c.kind.removeprefix("pair_"), c.joints]) for i, c in enumerate(PAIR_CODES) if "relativeRot" in c.kind]


@query(
    "q_pair_rotation",
    f"""WITH {ROTATIONS}, {sql.PAIRS}, c AS (SELECT * FROM {sql.values(_turns)} t(code_id, kind, pose_code)),
d AS (SELECT pair_id, c.code_id, c.kind, a.value - b.value + 0.0 AS value FROM pairs JOIN c ON true JOIN turned a ON a.pose_id = pose_a AND a.code_id = pose_code JOIN turned b ON b.pose_id = pose_b AND b.code_id = pose_code)
SELECT pair_id, code_id, round(value, 6) + 0.0 AS value, CASE kind {' '.join(f"WHEN '{k}' THEN {sql.bin_sql('value', PAIR_KINDS[k].thresholds)} + {catalog.PAIR_OFFSET[k]}" for k in ('pair_relativeRotX', 'pair_relativeRotY'))} END AS intptt_id FROM d""",
)
def pair_rotation(spark, sf_dir):
    """How the head's pitch and yaw change from pose A to pose B."""
    b = bodies(spark, sf_dir)
    out = pairs.change(codes.measure_rotations(b), pairs.pairs_of(b), ("pair_relativeRotX", "pair_relativeRotY"))
    return rounded(out.select("pair_id", "code_id", "value", "intptt_id"), "value")
