"""Row numbers, chunks, folds, samples and first-per-key without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, chunk_of
from sessionloom.operators.joins import group_lookup
from sessionloom.sources.scratch import materialise

_POSITION_BITS = 33  # monotonically_increasing_id: task number above, row in task below


def with_row_number(
    df: DataFrame, order_by: Sequence[str], within: Sequence[str] = (), name: str = "row_number"
) -> DataFrame:
    """1-based position in order, per group of ``within``, plus the group size ``group_rows``.

    A ranking window would sort a whole group (or, ungrouped, the whole table) in one task. Here
    the rows are range-partitioned and sorted once and written with their position; the size of
    each (group, task) block then gives the offset to add. ``order_by`` must be unique per group.
    """
    within = list(within)
    df = df.filter(all_present(within)) if within else df
    slot = F.monotonically_increasing_id()
    placed = materialise(
        df.repartitionByRange(*within, *order_by)
        .sortWithinPartitions(*within, *order_by)
        .withColumn("__slot", slot),
        "ordered",
    )
    placed = placed.withColumn("__block", F.shiftright("__slot", _POSITION_BITS))
    blocks = placed.groupBy(*within, "__block").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__slot").alias("__first")
    )
    group = Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)])
    earlier = group.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *within,
        "__block",
        "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(group).alias("group_rows"),
    )
    numbered = group_lookup(placed, offsets, [*within, "__block"])
    position = F.col("__slot") - F.col("__first") + F.col("__before") + 1
    return numbered.select(*df.columns, position.cast("bigint").alias(name), "group_rows")


def with_chunk(
    df: DataFrame, order_by: Sequence[str], chunks: int, within: Sequence[str] = (), name: str = "chunk"
) -> DataFrame:
    """Cut the ordered rows into near-equal runs; the first ones take the remainder rows."""
    numbered = with_row_number(df, order_by, within, "__position")
    return numbered.withColumn(name, chunk_of("__position", "group_rows", chunks)).select(*df.columns, name)


def stratified_folds(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Unshuffled stratified folds 0..folds-1: each label's rows, in key order, cut in runs."""
    return with_chunk(df, [key], folds, [label], "fold")


def first_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """First row of each key in a stated order. Spark limits each map task to one row per key
    before the shuffle, so a hot key stays small."""
    order = Window.partitionBy(*key).orderBy(*order_by)
    return df.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") == 1).drop("__rn")


def head_rows(df: DataFrame, order_by: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n random rows, fixed by the seed: the n smallest hashes of the key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
