"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import scratch, stored


def _rows(edges: DataFrame, *pairs: tuple[str, str], names: tuple[str, str] = ("u", "v")) -> DataFrame:
    """For each edge a row per pair of its columns."""
    return edges.select(F.inline(F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(pair, names, strict=True))) for pair in pairs))))


def _large_star(edges: DataFrame, seen: Observation) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node it knows; `seen` learns whether any edge was not part of a star."""
    ends = _rows(edges, ("u", "v"), ("v", "u"), names=("node", "other"))
    least = ends.groupBy("node").agg(F.min("other").alias("m"), F.count_if(F.col("other") < F.col("node")).alias("up"), F.count_if(F.col("other") > F.col("node")).alias("down"))
    least = least.observe(seen, F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open"))
    return edges.join(least.select(F.col("node").alias("v"), F.least("m", "node").alias("m")), "v").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _rows(edges.join(least, "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links (a, b) -> node, component (the smallest node reachable); nodes without links are absent.

    Links with a null end or with equal ends say nothing and are left out; order and repeats
    don't matter.  Every step is stored in the shared folder, as are the components, which alone stay;
    the driver sees one flag per round.  The number of rounds grows with the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    with scratch(links.sparkSession) as kept:
        edges = stored(edges.where("__a <> __b").select("u", "v").distinct(), "edges")
        while not edges.isEmpty():
            seen = Observation()
            large = stored(_large_star(edges, seen), "large-star")
            if not seen.get["open"]:
                break
            edges = stored(_small_star(large), "edges")
        stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return kept(stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
