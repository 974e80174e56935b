"""Augmentation of pose-text items: random exchange of left and right, and pairs turned into copies.

Draws are keyed hashes of the item's id, so an item is augmented alike in every run and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.exprs import uniform
from .text import flip


def flip_at_random(items: DataFrame, p: float = 0.5, seed: int = 0) -> DataFrame:
    """items (data_id, body, tokens) -> plus flipped; body and tokens are exchanged together, or neither.

    Items whose text can't be flipped (a guard word, see `text.flip`) stay as they are.  Null tokens: only the pose is flipped.
    """
    drawn = uniform(seed, "flip", F.col("data_id")) < p
    turned = items.withColumn("__turned", F.when(drawn, flip(F.col("tokens")))).withColumn("flipped", drawn & (F.col("__turned").isNotNull() | F.col("tokens").isNull()))
    changed = lambda c, to: F.when(F.col("flipped"), to).otherwise(F.col(c))
    return turned.withColumns({"body": changed("body", g.mirrored(F.col("body"))), "tokens": changed("tokens", F.col("__turned"))}).drop("__turned")


def copy_at_random(pairs: DataFrame, a: str, b: str, single: Column, p: float, always_b: bool = False, seed: int = 0) -> DataFrame:
    """pairs (data_id, text and two columns of poses) -> plus copied; a copied pair has one pose twice and an empty text.

    A becomes B where `single` holds (A stands for no pose there), or always with `always_b`; else B becomes A.
    """
    drawn = uniform(seed, "copy", F.col("data_id")) < p
    from_b = F.lit(True) if always_b else F.coalesce(single, F.lit(False))
    new = {a: F.when(drawn & from_b, F.col(b)).otherwise(F.col(a)), b: F.when(drawn & ~from_b, F.col(a)).otherwise(F.col(b)), "text": F.when(drawn, "").otherwise(F.col("text"))}
    return pairs.withColumns({**new, "copied": drawn})
