"""SQL text for DuckDB that says what the Spark operators must return."""

from __future__ import annotations

from ..functions.exprs import bin_sql, uniform_sql
from ..functions.geometry import FINGER
from . import catalog
from .catalog import AT, CODES, KINDS, PAIR_CODES, PAIR_KINDS


def values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + ")"


def _poses() -> str:
    """b: body joints; p: all joints, as lists of three numbers counted from 1."""
    body = ["[0.0, 0.0, 0.0]", *(f"[{', '.join(f'embedding[{3 * i + k}]::DOUBLE' for k in (1, 2, 3))}]" for i in range(21))]
    j = lambda n: f"b[{AT[n] + 1}]"
    diff = lambda a, k, c: f"({j(a)}[{k}] - {j(c)}[{k}])"
    fingers = []
    for s in catalog.SIDES:
        d = [diff(f"{s}_wrist", k, f"{s}_elbow") for k in (1, 2, 3)]
        n = f"greatest(sqrt({' + '.join(f'{x} * {x}' for x in d)}), 1e-12)"
        fingers.append("[" + ", ".join(f"{j(f'{s}_wrist')}[{k}] + {FINGER} * ({d[k - 1]} / {n})" for k in (1, 2, 3)) + f"] AS {s}_finger")
    mean = lambda *ps: "[" + ", ".join("(" + " + ".join(f"{p}[{k}]" for p in ps) + f") / {len(ps)}" for k in (1, 2, 3)) + "]"
    derived = ["left_finger", "right_finger"]
    derived += [mean(j(f"{s}_wrist"), f"{s}_finger") for s in catalog.SIDES]
    derived.append(mean(j("pelvis"), j("neck"), j("spine3")))
    for one, two in (("hip", "knee"), ("knee", "ankle"), ("shoulder", "elbow"), ("elbow", "wrist")):
        derived += [mean(j(f"{s}_{one}"), j(f"{s}_{two}")) for s in catalog.SIDES]
    return f"""b0 AS (SELECT vec_id AS pose_id, [{', '.join(body)}] AS b FROM embeddings),
b1 AS (SELECT pose_id, b, {', '.join(fingers)} FROM b0),
poses AS (SELECT pose_id, list_concat(b, [{', '.join(derived)}]) AS p FROM b1)"""


POSES = _poses()
UPRIGHT = f"least(p[{AT['left_ankle'] + 1}][2], p[{AT['right_ankle'] + 1}][2]) < (p[{AT['left_shoulder'] + 1}][2] + p[{AT['right_shoulder'] + 1}][2]) / 2 - 0.2"


def _value(kind: str) -> str:
    vec = lambda a, c: [f"(p[{a}][{k}] - p[{c}][{k}])" for k in (1, 2, 3)]
    length = lambda v: f"greatest(sqrt({' + '.join(f'{x} * {x}' for x in v)}), 1e-12)"
    acos = lambda x: f"degrees(acos(greatest(-1.0, least(1.0, {x}))))"
    if kind == "angle":
        u, w = vec("a", "b"), vec("d", "b")
        return acos(" + ".join(f"({x} / {length(u)}) * ({y} / {length(w)})" for x, y in zip(u, w, strict=True)))
    if kind == "distance":
        return f"sqrt({' + '.join(f'{x} * {x}' for x in vec('a', 'b'))})"
    if kind.startswith("relativePos"):
        k = "XYZ".index(kind[-1]) + 1
        return f"p[a][{k}] - p[b][{k}]"
    if kind == "relativeVAxis":
        w = vec("b", "a")
        return acos(f"abs({w[1]} / {length(w)})")
    if kind == "onGround":
        return "p[a][2] - list_min([x[2] for x in p])"
    le, ri, pe = (AT[n] + 1 for n in ("left_shoulder", "right_shoulder", "pelvis"))
    up = [f"((p[{le}][{k}] + p[{ri}][{k}]) / 2 - p[{pe}][{k}])" for k in (1, 2, 3)]
    if kind == "bodyInclineX":
        return f"CASE WHEN {UPRIGHT} THEN {acos(f'{up[1]} / {length(up[1:])}')} * sign({up[2]}) ELSE 0.0 END"
    if kind == "bodyInclineY":
        line = vec(le, ri)
        return f"{acos(f'{line[0]} / {length([line[0], line[2]])}')} * sign({line[2]})"
    return f"90.0 - {acos(f'{up[0]} / {length(up)}')}"


def _code_rows(kinds: tuple[str, ...]) -> list[tuple]:
    rows = []
    for i, c in enumerate(CODES):
        if c.kind in kinds:
            at = [AT[x] + 1 for x in c.joints[:3]]
            rows.append((i, c.kind, *(at + [at[0]] * (3 - len(at)))))
    return rows


POSITION_KINDS = tuple(k for k in KINDS if not k.startswith("relativeRot"))


def facts(kinds: tuple[str, ...] = POSITION_KINDS, noise_seed: int | None = None) -> str:
    """CTEs up to `facts` (pose_id, code_id, kind, value, bin, intptt_id)."""
    noise = "" if noise_seed is None else f" + (2 * {uniform_sql(noise_seed, 'noise', 'pose_id', 'code_id')} - 1) * CASE kind {' '.join(f'''WHEN '{k}' THEN {KINDS[k].noise}''' for k in kinds)} END"
    value = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_value(k)}" for k in kinds) + " END"
    bins = "CASE kind " + " ".join(f"WHEN '{k}' THEN {bin_sql('value', KINDS[k].thresholds)}" for k in kinds) + " END"
    ids = "CASE kind " + " ".join(f"WHEN '{k}' THEN {catalog.OFFSET[k]}" for k in kinds) + " END"
    return f"""{POSES},
codes AS (SELECT * FROM {values(_code_rows(kinds))} t(code_id, kind, a, b, d)),
measured AS (SELECT pose_id, code_id, kind, ({value}){noise} + 0.0 AS value FROM poses, codes),
binned AS (SELECT *, {bins} AS bin FROM measured),
facts AS (SELECT *, bin + {ids} AS intptt_id FROM binned)"""


def code_table() -> str:
    rows = [
        (i, catalog.OFFSET[c.kind] + n, int(x in c.accepted), int(x in c.rare), dict(c.support).get(x, 0), int(x in c.absolute))
        for i, c in enumerate(CODES)
        for n, x in enumerate(KINDS[c.kind].categories)
    ]
    return f"code_table AS (SELECT * FROM {values(rows)} t(code_id, intptt_id, accepted, rare, support, absolute))"


def requirements() -> str:
    rows = [
        (i, w, len(way), catalog.CODE_ID[kind, joints], catalog.OFFSET[kind] + KINDS[kind].categories.index(category), int(s.rare))
        for i, s in enumerate(catalog.SUPERS)
        for w, way in enumerate(s.ways)
        for kind, joints, category in way
    ]
    return f"req AS (SELECT * FROM {values(rows)} t(super_id, way, n_required, code_id, intptt_id, rare))"


def supers() -> str:
    """CTEs up to `supers` (pose_id, super_id, elig)."""
    return f"""{facts()}, {code_table()}, {requirements()},
ways AS (SELECT pose_id, super_id, way, max(r.rare) AS rare FROM facts f JOIN req r USING (code_id, intptt_id) GROUP BY ALL HAVING count(*) = max(n_required)),
supers AS (SELECT pose_id, super_id, max(rare) + 1 AS elig FROM ways GROUP BY ALL),
eligible AS (SELECT f.*, coalesce(accepted + rare, 0) AS elig FROM facts f LEFT JOIN code_table USING (code_id, intptt_id))"""


def resolved() -> str:
    """CTEs up to `resolved`: eligible with the support categories settled."""
    return f"""{supers()},
named AS (SELECT DISTINCT super_id, code_id, intptt_id FROM req),
one AS (SELECT DISTINCT code_id, intptt_id FROM code_table JOIN named USING (code_id, intptt_id) WHERE support = 1),
two AS (SELECT DISTINCT pose_id, code_id, intptt_id FROM supers JOIN named USING (super_id) JOIN code_table USING (code_id, intptt_id) WHERE support = 2),
resolved AS (
  SELECT e.* REPLACE (CASE WHEN one.code_id IS NOT NULL OR two.code_id IS NOT NULL THEN 0 ELSE elig END AS elig)
  FROM eligible e LEFT JOIN one USING (code_id, intptt_id) LEFT JOIN two USING (pose_id, code_id, intptt_id))"""


PAIRS = "pairs AS (SELECT a.vec_id // 2 AS pair_id, a.vec_id AS pose_a, b.vec_id AS pose_b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"


def pair_facts(kinds: tuple[str, ...]) -> str:
    """CTEs up to `pair_facts` (pair_id, code_id, kind, value, intptt_id)."""
    rows = [(i, c.kind, catalog.CODE_ID.get((c.kind.removeprefix("pair_"), c.joints), -1), AT[c.joints[0]] + 1, "XYZ".find(c.kind[-1]) + 1) for i, c in enumerate(PAIR_CODES) if c.kind in kinds]
    ids = "CASE kind " + " ".join(f"WHEN '{k}' THEN {bin_sql('value', PAIR_KINDS[k].thresholds)} + {catalog.PAIR_OFFSET[k]}" for k in kinds) + " END"
    return f"""{facts()}, {PAIRS},
up AS (SELECT pose_id, {UPRIGHT} AS up FROM poses),
pair_codes AS (SELECT * FROM {values(rows)} t(code_id, kind, pose_code, j, k)),
changes AS (
  SELECT pair_id, c.code_id, c.kind, CASE WHEN c.kind = 'pair_bodyInclineX' AND NOT (ua.up AND ub.up) THEN 0.0 ELSE fa.value - fb.value END + 0.0 AS value
  FROM pairs JOIN pair_codes c ON pose_code >= 0 AND c.kind NOT LIKE 'pair_relativePos%'
  JOIN facts fa ON fa.pose_id = pose_a AND fa.code_id = pose_code JOIN facts fb ON fb.pose_id = pose_b AND fb.code_id = pose_code
  JOIN up ua ON ua.pose_id = pose_a JOIN up ub ON ub.pose_id = pose_b
  UNION ALL
  SELECT pair_id, c.code_id, c.kind, pa.p[c.j][c.k] - pb.p[c.j][c.k] + 0.0
  FROM pairs JOIN pair_codes c ON c.kind LIKE 'pair_relativePos%' JOIN poses pa ON pa.pose_id = pose_a JOIN poses pb ON pb.pose_id = pose_b),
pair_facts AS (SELECT *, {ids} AS intptt_id FROM changes)"""
