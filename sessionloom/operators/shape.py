"""Projection, casting, pivoting and schema inspection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, number, zero_sum


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Natural join keys: names present on both sides, in left order."""
    there = set(right.columns)
    return [c for c in left.columns if c in there]


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns in one projection. A value out of range raises (ANSI)."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else c for c in df.columns])


def column_slice(df: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    """Columns by position, Python slice rules."""
    return df.select(*df.columns[start:stop])


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=[c for c in cols if c in df.columns])


def first_non_null(df: DataFrame, target: str, other: str) -> DataFrame:
    """Fill gaps of ``target`` from ``other`` and drop ``other``."""
    return df.withColumn(target, F.coalesce(target, other)).drop(other)


def pivot_sum(
    df: DataFrame,
    keys: Sequence[str],
    level_col: str,
    amount: str | Column,
    levels: Sequence[str],
    other: str | None = None,
) -> DataFrame:
    """One row per key, one summed column per level, 0 where a level is absent.

    The level list is given (``levels_of`` takes it from a small table), so a level nobody used still
    gets its column. Conditional sums keep it to a single shuffle with partial sums on the map side.
    Rows with a null key are left out. ``other`` names a column that gathers the amounts of unlisted and
    null levels. Without it rows with a null level are left out as well, and unlisted amounts are in no
    column; ``pivot_loss`` counts what such a pivot does not show.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    listed = F.coalesce(F.col(level_col).isin(*levels), F.lit(False))
    rest = [] if other is None else [zero_sum(F.when(~listed, amount)).alias(other)]
    return (
        df.filter(all_present([*keys, *([level_col] if other is None else [])]))
        .groupBy(*keys)
        .agg(*[zero_sum(F.when(F.col(level_col) == v, amount)).alias(v) for v in levels], *rest)
    )


def levels_of(df: DataFrame, level_col: str, most: int = 1000) -> list[str]:
    """The distinct values of a column of a small table, such as the site table; more than ``most`` raise."""
    rows = df.select(level_col).filter(F.col(level_col).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{level_col} has more than {most} values")
    return sorted(r[0] for r in rows)


def pivot_loss(
    df: DataFrame, keys: Sequence[str], level_col: str, amount: str | Column, levels: Sequence[str]
) -> DataFrame:
    """One row: amounts in all, in listed levels, in unlisted ones, without a level and without a key."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    keyed = all_present(list(keys))
    known = F.col(level_col).isNotNull()
    listed = F.coalesce(F.col(level_col).isin(*levels), F.lit(False))
    parts = {
        "total": F.lit(True),
        "listed": keyed & listed,
        "unlisted": keyed & known & ~listed,
        "no_level": keyed & ~known,
        "no_key": ~keyed,
    }
    return df.agg(*[zero_sum(F.when(test, amount)).alias(name) for name, test in parts.items()])


def unpivot_numeric(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form ``(ids..., feature, value double)`` without null or NaN values."""
    wide = df.select(*ids, *[number(c).alias(c) for c in cols])
    return wide.unpivot(list(ids), list(cols), "feature", "value").filter(F.col("value").isNotNull())


def stack_row(row: DataFrame, names: Sequence[str], stats: Mapping[str, str]) -> DataFrame:
    """Turn a one-row aggregate with columns ``{name}__{stat}`` into one row per name.

    ``stats`` maps each statistic to its type.
    """
    structs = [
        F.struct(
            F.lit(n).alias("column_name"),
            *[F.col(f"{n}__{s}").cast(t).alias(s) for s, t in stats.items()],
        )
        for n in names
    ]
    return row.select(F.inline(F.array(*structs)))


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type, row count and non-null count, in one pass."""
    names = df.columns
    types = dict(df.dtypes)
    counts = [F.count(F.col(c)).alias(f"{c}__non_null") for c in names]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *counts)
    for position, c in enumerate(names):
        row = row.withColumns(
            {
                f"{c}__position": F.lit(position),
                f"{c}__type_name": F.lit(types[c]),
                f"{c}__row_count": F.col("__rows"),
            }
        )
    return stack_row(
        row,
        names,
        {"position": "int", "type_name": "string", "row_count": "bigint", "non_null": "bigint"},
    )
