"""Integer codes for text attributes from a distributed dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.joins import lookup_join
from sessionloom.operators.ranking import with_row_number
from sessionloom.sources.scratch import materialise


def dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, value, code)``: the distinct values of each column, numbered from 0 in bytewise order.

    The values are made distinct in their tasks first and numbered over a range partitioning, so neither
    the driver nor a task ever holds a dictionary. Nulls have no code; numbers are coded by their text.
    """
    cols = list(cols)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    values = text.unpivot([], cols, "variable", "value").filter(F.col("value").isNotNull()).distinct()
    numbered = with_row_number(values, ["value"], ["variable"], "__place")
    return materialise(numbered.select("variable", "value", (F.col("__place") - 1).alias("code")), "dictionary")


def encode(df: DataFrame, cols: Sequence[str], codes: DataFrame | None = None, suffix: str = "_code") -> DataFrame:
    """Adds ``{column}{suffix}`` with the code of each value; null, or a value the dictionary lacks, stays null.

    ``codes`` is a table from ``dictionary`` (of these rows by default), so that other rows can be coded
    alike. Each column's dictionary is joined by its size: broadcast if small, else hot values are split.
    """
    codes = dictionary(df, cols) if codes is None else codes
    for c in cols:
        name = f"{c}{suffix}"
        if name in df.columns:
            raise ValueError(f"there is a column {name} already")
        own = codes.filter(F.col("variable") == c).select(F.col("value").alias("__value"), F.col("code").alias(name))
        df = lookup_join(df.withColumn("__value", F.col(c).cast("string")), own, ["__value"]).drop("__value")
    return df


def decode(df: DataFrame, col: str, codes: DataFrame, variable: str, name: str) -> DataFrame:
    """The value behind a code, as the column ``name``; an unknown code gives null."""
    own = codes.filter(F.col("variable") == variable).select(F.col("code").alias("__code"), F.col("value").alias(name))
    return lookup_join(df.withColumn("__code", F.col(col).cast("bigint")), own, ["__code"]).drop("__code")
