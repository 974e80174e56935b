"""Queries on codes put together and in order, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import uniform_sql
from ..functions.stages import stored
from ..operators import compose, rewrite
from . import oracle as sql
from ..sources.batches import batches
from .queries import query, table
from .text_queries import FORMATTED, settled

#: How often codes that can be said together are, in these queries.
P = 0.8
ID = "concat_ws('|', coalesce(side1, ''), part1, intptt, coalesce(side2, ''), coalesce(part2, ''))"
FUSED = f"""RECURSIVE {FORMATTED},
r AS (SELECT DISTINCT pose_id, side1, part1, {ID} AS id, concat_ws('|', coalesce(side1, ''), part1) AS subject, concat_ws('|', intptt, coalesce(side2, ''), coalesce(part2, '')) AS predicate FROM rows),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY pose_id ORDER BY {uniform_sql(0, 'fuse', 'pose_id', 'how', 'grp')}, how, grp) AS k
  FROM (SELECT pose_id, 'predicate' AS how, predicate AS grp, list(id) AS ids FROM r GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT pose_id, 'subject', subject, list(id) FROM r GROUP BY ALL HAVING count(*) > 1)),
rec AS (
  SELECT pose_id, 0::BIGINT AS k, []::VARCHAR[] AS used, []::VARCHAR[] AS got, '' AS how, '' AS grp FROM (SELECT DISTINCT pose_id FROM cand)
  UNION ALL
  SELECT c.pose_id, c.k, CASE WHEN len(x.l) > 1 THEN list_concat(rec.used, x.l) ELSE rec.used END, CASE WHEN len(x.l) > 1 THEN x.l ELSE [] END, c.how, c.grp
  FROM rec JOIN cand c ON c.pose_id = rec.pose_id AND c.k = rec.k + 1, LATERAL (SELECT [i FOR i IN c.ids IF NOT list_contains(rec.used, i)] AS l) x),
mem AS (SELECT pose_id, how, grp, unnest(got) AS id FROM rec WHERE {uniform_sql(0, 'fused', 'pose_id', 'how', 'grp')} < {P}),
said AS (SELECT r.pose_id, r.id, r.side1, r.part1, coalesce(how, 'alone') AS how, coalesce(grp, r.id) AS grp, {uniform_sql(0, 'member', 'r.pose_id', 'r.id')} AS d FROM r LEFT JOIN mem USING (pose_id, id)),
units AS (SELECT pose_id, how, grp, list(id ORDER BY d, id) AS ids, first(side1 ORDER BY d, id) AS side, first(part1 ORDER BY d, id) AS part FROM said GROUP BY pose_id, how, grp)"""
_steps = sql.values([(i, f"{a}>{b}") for i, (a, b) in enumerate(compose.edges())])
_ways = sql.values([(part, n, at, e) for part, ways in compose.paths().items() for n, way in enumerate(ways) for at, e in enumerate(way)])
_single = "CASE part WHEN 'feet' THEN 'foot' WHEN 'hands' THEN 'hand' ELSE part END"
PLACED = f"""{FUSED},
draws AS (SELECT pose_id, e, substr(md5('0|walk|' || pose_id || '|' || name), 1, 8) AS d FROM (SELECT DISTINCT pose_id FROM r), {_steps} t(e, name)),
routes AS (SELECT pose_id, spot, n, string_agg(d, '' ORDER BY pos) AS visit FROM draws JOIN {_ways} w(spot, n, pos, e) USING (e) GROUP BY ALL),
visits AS (SELECT pose_id, spot, min(visit) AS visit FROM routes GROUP BY ALL UNION ALL SELECT DISTINCT pose_id, 'body', '' FROM r),
there AS (SELECT DISTINCT pose_id, side || '_' || part AS spot FROM units WHERE side IN ('left', 'right')),
u2 AS (SELECT *, {_single} AS one, CASE WHEN {uniform_sql(0, 'side', 'pose_id', _single)} < 0.5 THEN 'left' ELSE 'right' END AS s FROM units),
u3 AS (
  SELECT *, CASE WHEN side IS DISTINCT FROM 'both' THEN concat_ws('_', side, part)
    WHEN NOT EXISTS (SELECT 1 FROM there t WHERE t.pose_id = u2.pose_id AND t.spot = s || '_' || one) AND EXISTS (SELECT 1 FROM there t WHERE t.pose_id = u2.pose_id AND t.spot = (CASE s WHEN 'left' THEN 'right' ELSE 'left' END) || '_' || one)
      THEN (CASE s WHEN 'left' THEN 'right' ELSE 'left' END) || '_' || one ELSE s || '_' || one END AS spot FROM u2),
placed AS (
  SELECT u3.*, row_number() OVER (PARTITION BY u3.pose_id ORDER BY coalesce(visit, '~'), u3.spot, {uniform_sql(0, 'unit', 'u3.pose_id', 'how', 'grp')}, how, grp) - 1 AS place FROM u3 LEFT JOIN visits USING (pose_id, spot))"""



def _joined(codes):
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.array_join(F.transform(codes, lambda c: F.concat_ws("|", text(c["side1"]), c["part1"], c["intptt"], text(c["side2"]), text(c["part2"]))), ";")


@query("q_fusion", f"WITH {FUSED} SELECT pose_id, how, grp, array_to_string(ids, ';') AS members FROM units")
def fusion(spark, sf_dir):
    """What each pose's codes are put together to: every code once, in drawn order inside its group."""
    rows = rewrite.formatted(settled(spark, sf_dir)[1])
    return compose.fuse(rows, p=P).select("pose_id", "how", "grp", _joined("codes").alias("members"))


@query("q_relevance_order", f"WITH {PLACED} SELECT pose_id, place, spot, how, grp FROM placed")
def relevance_order(spark, sf_dir):
    """The places of what is said of each pose, by a walk of the body of its own."""
    rows = rewrite.formatted(settled(spark, sf_dir)[1])
    return compose.ordered(compose.fuse(rows, p=P)).select("pose_id", F.col("place").cast("long").alias("place"), "spot", "how", "grp")


@query("q_part_walk", f"WITH {PLACED} SELECT pose_id, spot, visit FROM visits")
def part_walk(spark, sf_dir):
    """For each pose the order in which a depth-first walk of its own visits the parts."""
    rows = settled(spark, sf_dir)[0].select("pose_id").distinct()
    return rows.select("pose_id", F.explode(compose.walk(F.col("pose_id"))).alias("spot", "visit"))


@query(
    "q_batches",
    """WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('0|1|' || vec_id)) - 1 AS place, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, place // 32 AS batch, CAST(place % 32 AS INT) AS slot FROM o WHERE place // 32 < n // 32""",
)
def epoch_batches(spark, sf_dir):
    """The whole batches of an epoch, in its drawn order."""
    return batches(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], 32, epoch=1, drop_last=True)
