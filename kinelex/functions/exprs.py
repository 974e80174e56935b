"""Column helpers used all over the package."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` evaluated once per row however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(terms: list[Column]) -> Column:
    """Sum from left to right, as SQL text would do it."""
    return reduce(lambda a, b: a + b, terms)


def digits(seed: int, site: str, *keys: Column) -> Column:
    """The eight hexadecimal digits behind `uniform`: a text in the same order."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(site), *(k.cast("string") for k in keys))), 1, 8)


def uniform(seed: int, site: str, *keys: Column) -> Column:
    """A number in [0, 1) from seed, place of use and row keys: the same in every run, partitioning and engine."""
    return F.conv(digits(seed, site, *keys), 16, 10).cast("double") / 4294967296.0


def uniform_sql(seed: int, site: str, *keys: str) -> str:
    parts = "|| '|' ||".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(CAST('0x' || substr(md5('{seed}|{site}|' || {parts}), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"


def bin_of(value: Column, thresholds: tuple[float, ...]) -> Column:
    """Index of the first threshold that is not below the value, or their number: bounds are inclusive at the low side.

    A NaN exceeds every threshold and so falls into the last bin.
    """
    return total([F.when(value > t, 1).otherwise(0) for t in thresholds])


def bin_sql(value: str, thresholds: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN {value} > {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in thresholds) + ")"


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
