"""Binned tables: the data behind histograms, 2-D histograms and density curves."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, bin_of, edge_bin_of, number
from sessionloom.operators.joins import lookup_join
from sessionloom.operators.quantiles import trim
from sessionloom.operators.shape import unpivot_numeric
from sessionloom.sources.scratch import materialise


KERNEL_ROWS = 4096  # values of a batch that meet the whole grid at once


def histogram_edges(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts between given rising edges; the last bin is closed, values outside are dropped."""
    counts = (
        df.select(edge_bin_of(value, edges).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    lows = F.array(*[F.lit(float(e)) for e in edges])
    return (
        spine.join(counts, "bin", "left")
        .na.fill(0, subset=["n"])
        .select(
            "bin",
            F.element_at(lows, F.col("bin") + 1).alias("bin_lo"),
            F.element_at(lows, F.col("bin") + 2).alias("bin_hi"),
            "n",
        )
    )


def histogram_2d(df: DataFrame, x: str, x_edges: Sequence[float], y: str, y_edges: Sequence[float]) -> DataFrame:
    """Dense counts over a grid of fixed edges."""
    counts = (
        df.select(edge_bin_of(x, x_edges).alias("x_bin"), edge_bin_of(y, y_edges).alias("y_bin"))
        .dropna()
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    nx, ny = len(x_edges) - 1, len(y_edges) - 1
    cells = df.sparkSession.range(nx * ny).select(
        F.floor(F.col("id") / ny).cast("int").alias("x_bin"), (F.col("id") % ny).cast("int").alias("y_bin")
    )
    return cells.join(counts, ["x_bin", "y_bin"], "left").na.fill(0, subset=["n"])


def _ranges(data: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bin range per group; a single-valued group is widened by a half on each side."""
    lo, hi = F.min("value"), F.max("value")
    flat = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0))
    return data.groupBy(*group).agg((lo - flat).alias("lo"), (hi + flat).alias("hi"))


def _bin_counts(
    ranged: DataFrame, ranges: DataFrame, on: Sequence[str], split: Sequence[str], bins: int
) -> DataFrame:
    """Counts per (on..., split..., bin), empty bins included. ``ranged``: the rows with their range."""
    bin_no = bin_of("value", "lo", "hi", bins).alias("bin")
    counts = ranged.groupBy(*on, *split, bin_no).agg(F.count(F.lit(1)).alias("n"))
    shown = ranges
    if split:
        shown = counts.select(*on, *split).distinct().join(ranges, list(on))
    spine = shown.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    return (
        spine.join(counts, [*on, *split, "bin"], "left")
        .na.fill(0, subset=["n"])
        .select(
            *on,
            *split,
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
            "n",
        )
    )


def shared_bins(
    df: DataFrame, value: str, subsets: Mapping[str, Column], bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Counts of all rows (``n``) and of subsets of them over the same equal-width bins, per group.

    The range is that of all rows, so a subset's curve can be laid over the whole. One pass for the
    ranges, one for the counts.
    """
    by = list(by)
    x = number(value)
    data = df.select(*by, x.alias("value"), *[c.alias(name) for name, c in subsets.items()]).filter(all_present([*by, "value"]))
    ranges = _ranges(data, by)
    if by:
        ranges = materialise(ranges, "ranges")
        ranged = lookup_join(data, ranges, by, "inner")
    else:
        edge = ranges.select(F.struct("lo", "hi").alias("e")).scalar()
        ranged = data.withColumn("__e", edge).withColumns({"lo": F.col("__e.lo"), "hi": F.col("__e.hi")}).drop("__e")
    bin_no = bin_of("value", "lo", "hi", bins).alias("bin")
    counts = ranged.groupBy(*by, bin_no).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(name)).alias(name) for name in subsets]
    )
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    filled = spine.join(counts, [*by, "bin"], "left").na.fill(0, subset=["n", *subsets])
    lo = F.col("lo") + F.col("bin") * width
    return filled.select(*by, "bin", lo.alias("bin_lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "n", *subsets)


def _with_column_range(data: DataFrame, ranges: DataFrame) -> DataFrame:
    return data.join(F.broadcast(ranges), "feature")  # one row per listed column


def histograms(
    df: DataFrame, values: Sequence[str], bins: int, by: Sequence[str] = (), nonzero_only: bool = False
) -> DataFrame:
    """Equal-width histograms of several columns, each over its own range.

    With ``by``, each group has its own range as well. One job for all columns and groups:
    a pass for the ranges, a pass for the counts, both combined before the shuffle.
    """
    by = list(by)
    data = unpivot_numeric(df, values, by)
    data = data.filter(all_present(by)) if by else data
    data = data.filter(F.col("value") > 0) if nonzero_only else data
    on = [*by, "feature"]
    ranges = _ranges(data, on)
    if by:
        ranges = materialise(ranges, "ranges")
        return _bin_counts(lookup_join(data, ranges, on, "inner"), ranges, on, [], bins)
    return _bin_counts(_with_column_range(data, ranges), ranges, on, [], bins)


def trimmed_histograms(
    df: DataFrame, value: str, prob: float, by: Sequence[str], bins: int = 10
) -> DataFrame:
    """Drop the tail above the global quantile, then one histogram per group."""
    return histograms(trim(df, value, prob, "upper"), [value], bins, by)


def tail_histogram(df: DataFrame, value: str, prob: float, split: str, bins: int = 50) -> DataFrame:
    """Rows at or above the global quantile, common bins for all classes, split by class."""
    data = unpivot_numeric(trim(df, value, prob, "lower"), [value], [split]).filter(all_present([split]))
    ranges = _ranges(data, ["feature"])
    return _bin_counts(_with_column_range(data, ranges), ranges, ["feature"], [split], bins)


def density_curve(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid from min to max, bandwidth sd * n^(-1/5); NaN is missing.

    A first scan gives the grid, when this is called. In the second every task adds up the kernel at all
    points of the grid and sends one row, whether the column has ten distinct values or one per row. A
    column without spread (constant, or one value) has density 1 at its value, which is the whole grid;
    one without values has no curve.
    """
    x = number(value)
    shape = df.agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")
    ).first()
    if not shape.n:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    at = [shape.lo + i * (shape.hi - shape.lo) / (points - 1) for i in range(points)]
    width = (shape.sd or 0.0) * shape.n ** -0.2
    if not width:
        rows = [(i, g, 1.0) for i, g in enumerate(at)]
        return df.sparkSession.createDataFrame(rows, "point int, x double, density double")

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, total = np.array(at)[:, None], np.zeros(points)
        for batch in batches:
            values = batch.column(0).to_numpy()
            for start in range(0, len(values), KERNEL_ROWS):
                z = (grid - values[start : start + KERNEL_ROWS]) / width
                total += np.exp(z * z * -0.5).sum(1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], names=["point", "k"]
        )

    known = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    sums = known.mapInArrow(kernels, "point int, k double").groupBy("point").agg(F.sum("k").alias("k"))
    norm = shape.n * width * math.sqrt(2.0 * math.pi)
    grid_at = F.get(F.array(*map(F.lit, at)), "point")
    return sums.select("point", grid_at.alias("x"), (F.col("k") / norm).alias("density"))


def pair_bins(
    df: DataFrame, x_cols: Sequence[str], y_cols: Sequence[str], split: str, bins: int, y_bins: int | None = None
) -> DataFrame:
    """Counts per (x column, y column, class, x bin, y value) for every column pair at once.

    With ``y_bins`` the y columns are binned over their own ranges too and ``y_bin`` takes the place of
    ``y``. Rows then shrink to one per tuple of bins, in their tasks, before the pairs are formed.
    """
    if y_bins is not None:
        return _binned_pairs(df, x_cols, y_cols, split, bins, y_bins)
    cells = [
        F.struct(
            F.lit(x).alias("x_feature"),
            F.lit(y).alias("y_feature"),
            F.col(x).cast("double").alias("x"),
            F.col(y).cast("double").alias("y"),
        )
        for x in x_cols
        for y in y_cols
    ]
    ranges = _ranges(unpivot_numeric(df, x_cols), ["feature"]).withColumnRenamed("feature", "x_feature")
    long = df.select(split, F.inline(F.array(*cells))).dropna()
    binned = long.join(F.broadcast(ranges), "x_feature")  # one row per listed x column
    return binned.groupBy(
        "x_feature", "y_feature", split, bin_of("x", "lo", "hi", bins).alias("x_bin"), "y"
    ).agg(F.count(F.lit(1)).alias("n"))


def _binned_pairs(
    df: DataFrame, x_cols: Sequence[str], y_cols: Sequence[str], split: str, x_bins: int, y_bins: int
) -> DataFrame:
    cols = {f"x{i}": (c, x_bins) for i, c in enumerate(x_cols)} | {f"y{i}": (c, y_bins) for i, c in enumerate(y_cols)}
    edges = []
    for name, (c, _) in cols.items():
        lo, hi = F.min(number(c)), F.max(number(c))
        flat = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0))
        edges += [(lo - flat).alias(f"{name}_lo"), (hi + flat).alias(f"{name}_hi")]
    ranges = df.agg(F.struct(*edges)).scalar()
    at = {name: bin_of(number(c), F.col(f"__r.{name}_lo"), F.col(f"__r.{name}_hi"), n) for name, (c, n) in cols.items()}
    tuples = df.filter(all_present([split])).withColumn("__r", ranges).select(split, *[e.alias(f"__{n}") for n, e in at.items()])
    counted = tuples.groupBy(split, *[f"__{n}" for n in cols]).agg(F.count(F.lit(1)).alias("__n"))
    cells = [
        F.struct(
            F.lit(x).alias("x_feature"), F.lit(y).alias("y_feature"),
            F.col(f"__x{i}").alias("x_bin"), F.col(f"__y{j}").alias("y_bin"),
        )
        for i, x in enumerate(x_cols)
        for j, y in enumerate(y_cols)
    ]
    long = counted.select(split, "__n", F.inline(F.array(*cells))).filter(all_present(["x_bin", "y_bin"]))
    return long.groupBy("x_feature", "y_feature", split, "x_bin", "y_bin").agg(F.sum("__n").alias("n"))


def day_ranges(df: DataFrame, group: Sequence[str], day: str) -> DataFrame:
    """Rows, first and last day per group."""
    return df.filter(all_present(group)).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )
