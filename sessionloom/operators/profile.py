"""Column profiles, value shares, correlations, contingency counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, any_null, number, percent
from sessionloom.operators.quantiles import described
from sessionloom.operators.shape import stack_row

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max per column, not rounded; NaN counts as missing.

    The moments come from the first scan of the quartiles' refinement, which runs when this is called.
    ``exact=False`` takes the quartiles from a sketch instead, in one lazy scan.
    """
    cols = list(cols)
    shown = ["column_name", "count", "mean", "std", "min", *QUARTILES, "max"]
    if exact:
        schema = "column_name string, count bigint, mean double, std double, min double, max double, " + ", ".join(
            f"{q} double" for q in QUARTILES
        )
        return df.sparkSession.createDataFrame(described(df, cols, list(QUARTILES.values())), schema).select(*shown)

    def row(c: str) -> Column:
        x = number(c)
        marks = F.percentile_approx(x, list(QUARTILES.values()), 10_000)
        return F.struct(
            F.lit(c).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"), *[marks[i].alias(q) for i, q in enumerate(QUARTILES)],
        )

    wide = df.agg(*[row(c).alias(f"__{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[f"__{i}" for i in range(len(cols))]))).select(*shown)


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__missing") for c in cols])
    return stack_row(row, cols, {"missing": "bigint"})


def sparsity_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero, non-zero and non-null counts per column with their percentages, in one pass.

    ``nonzero_or_null`` counts a missing value as different from 0; ``nonzero`` does not. NaN is missing.
    """
    cols = list(cols)
    known = {"double", "float"}
    df = df.withColumns({c: number(c) for c, t in df.dtypes if c in cols and t in known})
    row = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[
            e.alias(f"{c}__{name}")
            for c in cols
            for name, e in (
                ("zero", F.count_if(F.col(c) == 0)),
                ("nonzero", F.count_if(F.col(c) != 0)),
                ("non_null", F.count(F.col(c))),
            )
        ],
    )
    extra: dict[str, Column] = {}
    for c in cols:
        zero, non_null = F.col(f"{c}__zero"), F.col(f"{c}__non_null")
        either = F.col("__rows") - zero
        extra[f"{c}__nonzero_or_null"] = either
        extra[f"{c}__pct_zero"] = percent(zero, non_null)
        extra[f"{c}__pct_nonzero"] = percent(either, non_null)
        extra[f"{c}__zero_share_of_rows"] = F.try_divide(zero, F.col("__rows"))
    return stack_row(
        row.withColumns(extra),
        cols,
        {
            "zero": "bigint",
            "nonzero": "bigint",
            "nonzero_or_null": "bigint",
            "non_null": "bigint",
            "pct_zero": "double",
            "pct_nonzero": "double",
            "zero_share_of_rows": "double",
        },
    )


def _block_moments(x: np.ndarray) -> np.ndarray:
    """Per column pair (i, j), over the rows where both are known: rows, mean of i, squared deviations of i
    and products of deviations, as four matrices. Columns are taken from a value of their own near the
    mean first, so that nothing large cancels and a constant has no spread at all."""
    known = ~np.isnan(x)
    count = known.sum(0)
    mean = np.where(known, x, 0).sum(0) / np.maximum(count, 1)
    gap = np.where(known, np.abs(x - mean), np.inf)
    base = np.where(count > 0, x[gap.argmin(0), np.arange(x.shape[1])], 0.0)
    z, m = np.where(known, x - base, 0), known.astype(np.float64)
    n, total, square = m.T @ m, z.T @ m, (z * z).T @ m
    share = np.maximum(n, 1)
    spread = square - total**2 / share
    spread[spread <= 1e-14 * square] = 0  # a constant within these rows
    return np.stack([n, np.where(n > 0, base[:, None] + total / share, 0), spread, z.T @ z - total * total.T / share])


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = np.maximum(n, 1)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0)
    weight = a[0] * b[0] / share
    mean = np.where(a[0] > 0, a[1], b[1]) + gap * b[0] / share
    return np.stack([n, mean, a[2] + b[2] + gap**2 * weight, a[3] + b[3] + gap * gap.T * weight])


def _task_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per column pair for all rows of a task."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = _block_moments(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            total = part if total is None else _merged_moments(total, part)
    if total is not None:
        i, j = np.triu_indices(total.shape[1])
        n, mean, spread, product = total
        found = [i.astype(np.int32), j.astype(np.int32), n[i, j], mean[i, j], mean[j, i], spread[i, j], spread[j, i], product[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form ``(row_name, col_name, r)``; NaN counts as missing.

    r is null when a column is constant or a pair has no complete row. The rows of a task become a few
    matrices (counts, means, sums of products), multiplied as blocks, so no row is repeated per pair;
    what is shuffled is one row per pair and task, and these are merged around their means.
    """
    cols = list(cols)
    numbers = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    moments = "n double, x double, y double, xx double, yy double, xy double"
    parts = numbers.mapInArrow(_task_moments, f"i int, j int, {moments}").filter("n > 0")
    fields = ("n", "x", "y", "xx", "yy", "xy")

    def merged(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        dx, dy, weight = b["x"] - a["x"], b["y"] - a["y"], a["n"] * b["n"] / n
        found = (
            n, a["x"] + dx * b["n"] / n, a["y"] + dy * b["n"] / n,
            a["xx"] + b["xx"] + dx * dx * weight, a["yy"] + b["yy"] + dy * dy * weight, a["xy"] + b["xy"] + dx * dy * weight,
        )
        return F.struct(*[c.alias(f) for f, c in zip(fields, found)])

    per_pair = parts.groupBy("i", "j").agg(F.collect_list(F.struct(*fields)).alias("p"))
    whole = F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0)), merged)
    known = per_pair.select("i", "j", whole.alias("m"))
    r = F.col("m.xy") / F.nullif(F.sqrt(F.col("m.xx") * F.col("m.yy")), F.lit(0.0))
    p = len(cols)
    every = df.sparkSession.range(p * p).select(
        F.floor(F.col("id") / p).cast("int").alias("a"), (F.col("id") % p).cast("int").alias("b")
    )
    names = F.array(*[F.lit(c) for c in cols])
    cells = every.withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")}).join(known, ["i", "j"], "left")
    return cells.select(F.get(names, "a").alias("row_name"), F.get(names, "b").alias("col_name"), r.alias("r"))


def value_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts and shares for several columns, most frequent first: ``(variable, value, n,
    share)``, no nulls."""
    cols = list(cols)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    counts = (
        text.unpivot([], cols, "variable", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("variable").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "variable")  # one row per listed column
    share = (F.col("n") / F.col("total")).alias("share")
    return shares.select("variable", "value", "n", share).orderBy("variable", F.desc("n"), "value")


def attribute_variability(df: DataFrame, entity: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean over entities of the number of distinct values of each attribute.

    1 means the attribute never changes within an entity. Entities with no value are left out.
    The long form keeps it to one distinct and two counts for all attributes together.
    """
    cols = list(cols)
    text = df.filter(all_present(entity)).select(*entity, *[F.col(c).cast("string").alias(c) for c in cols])
    values = text.unpivot(list(entity), cols, "variable", "value").filter(F.col("value").isNotNull())
    per_entity = values.distinct().groupBy(*entity, "variable").agg(F.count(F.lit(1)).alias("distinct_values"))
    return per_entity.groupBy("variable").agg(
        F.count(F.lit(1)).alias("entities"), F.avg("distinct_values").alias("mean_distinct")
    )


def incomplete_entities(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many entities lack at least one attribute. Input: one row per entity."""
    gap = any_null(cols)
    return df.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(gap).alias("incomplete"),
        F.count_if(~gap).alias("complete"),
    )


def distinct_count(df: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """Distinct non-null values per group. The inner distinct spreads a hot group over tasks."""
    return (
        df.filter(all_present(by))
        .select(*by, col)
        .distinct()
        .groupBy(*by)
        .agg(F.count(col).alias(name))
    )


def contingency(df: DataFrame, a: str, a_values: Sequence, b: str, b_values: Sequence) -> DataFrame:
    """Dense count table over two fixed domains, absent cells as 0. Rows outside the domains are in no cell;
    ``contingency_loss`` counts them."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.range(len(a_values) * len(b_values)).select(
        F.element_at(F.array(*map(F.lit, a_values)), (F.floor(F.col("id") / len(b_values)) + 1).cast("int")).alias(a),
        F.element_at(F.array(*map(F.lit, b_values)), (F.col("id") % len(b_values) + 1).cast("int")).alias(b),
    )
    return cells.join(counts, [a, b], "left").na.fill(0, subset=["n"])


def contingency_loss(df: DataFrame, a: str, a_values: Sequence, b: str, b_values: Sequence) -> DataFrame:
    """One row: rows in all, in the table's cells, with a value outside its domain, and with a null."""
    inside = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    listed, gap = inside(a, a_values) & inside(b, b_values), any_null([a, b])
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(listed).alias("listed"),
        F.count_if(~listed & ~gap).alias("unlisted"),
        F.count_if(gap).alias("no_value"),
    )


def stacked_counts(df: DataFrame, row: str, stack: str, levels: Sequence, other: str | None = None) -> DataFrame:
    """Counts per row value with one column per level (the data of a stacked bar).

    ``other`` names a column for the rows whose level is not listed or null, so that the columns add up
    to the rows of a bar.
    """
    listed = F.coalesce(F.col(stack).isin(*levels), F.lit(False))
    rest = [] if other is None else [F.count_if(~listed).alias(other)]
    return df.filter(all_present([row])).groupBy(row).agg(
        *[F.count_if(F.col(stack) == v).alias(f"n_{v}") for v in levels], *rest
    )
