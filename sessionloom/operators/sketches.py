"""Distinct counts that roll up: one sketch per key and day, merged into weeks, sessions or any coarser key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present

# Registers are 2**PRECISION.
PRECISION = 12


def relative_error(precision: int = PRECISION) -> float:
    """One standard error of a merged sketch, as a share of the count."""
    return 1.04 / 2 ** (precision / 2)


def daily_sketches(df: DataFrame, keys: Sequence[str], item: str, precision: int = PRECISION) -> DataFrame:
    """``(keys..., sketch)``: the distinct items of every key, in at most 2**precision bytes or so each.

    The exact count must see every (key, item) again for each coarser grouping; a sketch is read instead.
    Null items are not counted; rows with a null key are left out.
    """
    known = df.filter(all_present(list(keys)))
    return known.groupBy(*keys).agg(F.hll_sketch_agg(item, precision).alias("sketch"))


def roll_up(sketches: DataFrame, keys: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Merge sketches into coarser keys, given by name or as expressions of the finer ones."""
    named = keys if isinstance(keys, Mapping) else {k: F.col(k) for k in keys}
    return sketches.groupBy(*[c.alias(k) for k, c in named.items()]).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, name: str = "estimate") -> DataFrame:
    """The sketches' distinct counts as a column; the sketch itself goes."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def within_error(estimate: Column, exact: Column, precision: int = PRECISION, times: float = 4.0) -> Column:
    """Whether an estimate is within ``times`` standard errors, and one, of the exact count."""
    return F.abs(estimate - exact) <= exact * (times * relative_error(precision)) + 1
