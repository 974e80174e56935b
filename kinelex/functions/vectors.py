"""Expressions on arrays: norms, masks, pooling, parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import let


def l2_normalised(v: Column) -> Column:
    """A vector of length one; a zero vector stays zero."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(F.greatest(length, F.lit(1e-12)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def padding_mask(length: Column, longest: int) -> Column:
    """1 for places before `length`, 0 for the padding behind."""
    return F.transform(F.sequence(F.lit(0), F.lit(longest - 1)), lambda i: F.when(i < length, 1).otherwise(0))


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors whose mask isn't 0, component by component; null where there is none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dim), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    n = F.size(kept)
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def pose_parts(v: Column) -> Column:
    """The root's rotation, those of the other body joints, and what belongs to the hands."""
    return F.struct(F.slice(v, 1, 3).alias("root"), F.slice(v, 4, 63).alias("body"), F.slice(v, F.lit(67), F.greatest(F.size(v) - 66, F.lit(0))).alias("hands"))
