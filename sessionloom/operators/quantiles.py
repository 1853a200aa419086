"""Exact interpolated quantiles by repeated refinement, and filters on them.

A first scan counts every column in fixed bins of a logarithmic scale. Each wanted rank lies in one bin;
the next scan cuts only those bins again, this time evenly between the smallest and the largest value
found inside, and so on until a rank is the first or last row of its bin or few rows are left, which are
then counted by value. All that is ever shuffled is one count per bin and task, and windows run over bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, number
from sessionloom.operators.joins import lookup_join
from sessionloom.operators.shape import unpivot_numeric
from sessionloom.sources.scratch import materialise

# Bins a bracket is cut into by one scan; a bracket of up to FEW times as many rows is counted by value.
ACCURACY = 4096
FEW = 10
# Width of the fixed bins of the first scan, on the scale sign(x) * log(1 + |x|).
WIDTH = 0.25
MOMENTS = ("mean", "std", "min", "max")

_STATE = "__feature int, __n bigint, __before bigint, __inside bigint, __lo double, __hi double, __ranks array<bigint>"


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by..., __feature int, __x double)`` without null or NaN values."""
    df = df.filter(all_present(by)) if by else df
    numbers = F.array(*[number(c) for c in cols])
    return df.select(*by, F.posexplode(numbers).alias("__feature", "__x")).filter(F.col("__x").isNotNull())


def _located(counts: DataFrame, bracket: Sequence[str]) -> DataFrame:
    """The bins that hold wanted ranks. ``counts`` has one row per bin of a bracket, with ``__base`` rows
    below the bracket and the bracket's ``__ranks``."""
    inside = Window.partitionBy(*bracket).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__base") + F.coalesce(F.sum("__inside").over(inside), F.lit(0))
    placed = counts.withColumn("__before", before)
    mine = F.filter("__ranks", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__inside")))
    return placed.withColumn("__ranks", mine).filter(F.size("__ranks") > 0)


def _first_scan(data: DataFrame, by: Sequence[str], probs: Sequence[float], moments: bool) -> DataFrame:
    group, x = [*by, "__feature"], F.col("__x")
    slot = F.floor(F.signum(x) * F.log1p(F.abs(x)) / WIDTH).cast("double")
    extra = [F.avg(x).alias("__avg"), F.var_pop(x).alias("__var")] if moments else []
    counts = data.groupBy(*group, slot.alias("__slot")).agg(
        F.count(F.lit(1)).alias("__inside"), F.min(x).alias("__lo"), F.max(x).alias("__hi"), *extra
    )
    whole = Window.partitionBy(*group)
    counts = counts.withColumn("__n", F.sum("__inside").over(whole))
    if moments:
        n = F.col("__n")
        share = F.sum(F.col("__inside") * F.col("__avg")).over(whole) / n
        counts = counts.withColumns({"mean": share, "min": F.min("__lo").over(whole), "max": F.max("__hi").over(whole)})
        spread = F.col("__inside") * (F.col("__var") + F.pow(F.col("__avg") - F.col("mean"), F.lit(2.0)))
        counts = counts.withColumn("std", F.sqrt(F.try_divide(F.sum(spread).over(whole), n - 1)))
    low = [F.floor((F.col("__n") - 1) * p) for p in probs]
    wanted = F.array_distinct(F.array(*low, *[F.least(r + 1, F.col("__n") - 1) for r in low]))
    counts = counts.withColumns({"__ranks": wanted, "__base": F.lit(0).cast("bigint")})
    state = _located(counts, group)
    return state.select(*by, *_names(), *(MOMENTS if moments else ()))


def _names() -> list[str]:
    return [field.split(" ")[0] for field in _STATE.split(", ")]


def _slot(x: Column, lo: Column, hi: Column, inside: Column, bins: int) -> Column:
    """Where a bracket's value is counted: by itself if few rows are left, else in one of the even bins."""
    even = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("double")
    return F.when(inside <= FEW * bins, x).otherwise(even)


def _counted(hit: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    x = F.col("__x")
    return hit.groupBy(*keys, "__base", "__slot").agg(
        F.count(F.lit(1)).alias("__inside"), F.min(x).alias("__lo"), F.max(x).alias("__hi"), *extra
    )


def _next_scan(df: DataFrame, cols: Sequence[str], todo: dict[int, list[tuple]], bins: int) -> DataFrame:
    """Cut brackets again that the driver knows: plain comparisons with literals on the columns that need it.

    ``todo`` has ``(lo, hi, before, inside, ranks)`` per column number.
    """
    number_of = lambda v: f"double('{v!r}')"
    hits, wanted = [], []
    for f, brackets in todo.items():
        cases = []
        for lo, hi, before, inside, ranks in brackets:
            low, high = number_of(lo), number_of(hi)
            even = f"cast(least(floor((x{f} - {low}) / ({high} - {low}) * {bins}), {bins - 1}) as double)"
            slot = f"x{f}" if inside <= FEW * bins else even
            row = f"named_struct('__feature', {f}, '__base', {before}L, '__slot', {slot}, '__x', x{f})"
            cases.append(f"when x{f} >= {low} and x{f} <= {high} then {row}")
            wanted.append(f"when __feature = {f} and __base = {before}L then array({', '.join(f'{r}L' for r in ranks)})")
        hits.append(f"case {' '.join(cases)} end")
    numbers = df.select(*[number(cols[f]).alias(f"x{f}") for f in todo])
    hit = numbers.select(F.expr(f"inline(array({', '.join(hits)}))")).filter(F.col("__feature").isNotNull())
    counts = _counted(hit, ["__feature"]).withColumn("__ranks", F.expr(f"case {' '.join(wanted)} end"))
    return _located(counts, ["__feature", "__base"])


def _next_scan_by(data: DataFrame, brackets: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Cut brackets again that are in a written table: an array ``__b`` of them per group."""
    group, x = [*by, "__feature"], F.col("__x")
    each = lookup_join(data, brackets, group, "inner").select(*group, "__n", "__x", F.inline("__b"))
    inside = each.filter((x >= F.col("__lo")) & (x <= F.col("__hi")))
    slot = _slot(x, F.col("__lo"), F.col("__hi"), F.col("__inside"), bins)
    hit = inside.select(*group, "__n", "__x", F.col("__before").alias("__base"), slot.alias("__slot"), "__ranks")
    counts = _counted(hit, [*group, "__n"], F.first("__ranks").alias("__ranks"))
    return _located(counts, [*group, "__base"]).select(*by, *_names())


def _value(rank: Column) -> Column:
    """The value at a rank, null while its bin holds others."""
    first = (rank == F.col("__before")) | (F.col("__lo") == F.col("__hi"))
    return F.when(first, F.col("__lo")).when(rank == F.col("__before") + F.col("__inside") - 1, F.col("__hi"))


def _open(state: DataFrame) -> DataFrame:
    ranks = F.filter("__ranks", lambda r: _value(r).isNull())
    return state.withColumn("__ranks", ranks).filter(F.size("__ranks") > 0)


def _interpolated(n, a, b, low, prob: float):
    t = (n - 1) * prob - low
    return t, b - (b - a) * (1 - t), a + (b - a) * t


def _whole_table(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], bins: int, moments: bool
) -> dict[int, tuple[Row, dict[int, float]]]:
    """Per column number: a row of the first scan and the values at the wanted ranks. What is collected is
    bounded by columns times probs."""
    rows = _first_scan(_long(df, cols, ()), (), probs, moments).collect()
    shown = {r["__feature"]: (r, {}) for r in rows}
    while rows:
        todo: dict[int, list[tuple]] = {}
        for r in rows:
            last, found, left = r["__before"] + r["__inside"] - 1, shown[r["__feature"]][1], []
            for rank in r["__ranks"]:
                if rank == r["__before"] or r["__lo"] == r["__hi"]:
                    found[rank] = r["__lo"]
                elif rank == last:
                    found[rank] = r["__hi"]
                else:
                    left.append(rank)
            if left:
                todo.setdefault(r["__feature"], []).append((r["__lo"], r["__hi"], r["__before"], r["__inside"], left))
        if not todo:
            break
        rows = _next_scan(df, cols, todo, bins).collect()
    return shown


def _by_group(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], bins: int) -> DataFrame:
    """``(by..., __feature, __n, __rank, __value)``; brackets stay in written tables."""
    data = _long(df, cols, by)
    state = materialise(_first_scan(data, by, probs, False), "brackets")
    found = []
    while True:
        pairs = F.inline(F.transform("__ranks", lambda r: F.struct(r.alias("__rank"), _value(r).alias("__value"))))
        found.append(state.select(*by, "__feature", "__n", pairs).filter(F.col("__value").isNotNull()))
        left = _open(state)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        one = F.struct("__lo", "__hi", "__before", "__inside", "__ranks")
        brackets = left.groupBy(*by, "__feature", "__n").agg(F.collect_list(one).alias("__b"))
        state = materialise(_next_scan_by(data, materialise(brackets, "brackets"), by, bins), "brackets")


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linear-interpolation quantiles: one row per (by..., feature, prob). NaN counts as missing; a column
    (of a group) without values has no row.

    Every scan cuts the brackets that still hold wanted ranks into ``accuracy`` bins, so a column of n
    rows takes about 1 + log(n) / log(accuracy) scans, two or three up to a hundred million rows. The
    scans run when this is called; ``df`` is read once per scan, so give it a written table if it is costly.
    """
    cols, by, probs = list(cols), list(by), _sorted(probs)
    names = F.array(*[F.lit(c) for c in cols])
    if not by:
        shown = _whole_table(df, cols, probs, accuracy, False)
        rows = [(cols[f], p, q) for f, (r, values) in sorted(shown.items()) for p, q in _picked(r, values, probs)]
        return df.sparkSession.createDataFrame(rows, "feature string, prob double, quantile double")
    at = F.map_from_entries(F.collect_set(F.struct("__rank", "__value")))
    values = _by_group(df, cols, probs, by, accuracy).groupBy(*by, "__feature", "__n").agg(at.alias("__at"))
    rows = []
    for p in probs:
        low = F.floor((F.col("__n") - 1) * p)
        a, b = F.element_at("__at", low), F.element_at("__at", F.least(low + 1, F.col("__n") - 1))
        t, high, below = _interpolated(F.col("__n"), a, b, low, p)
        value = F.when(t == 0, a).when(t >= 0.5, high).otherwise(below)  # the next value may be infinite
        rows.append(F.struct(F.lit(p).alias("prob"), value.alias("quantile")))
    return values.select(*by, F.get(names, "__feature").alias("feature"), F.inline(F.array(*rows)))


def _picked(r: Row, values: dict[int, float], probs: Sequence[float]) -> list[tuple[float, float]]:
    out, n = [], r["__n"]
    for p in probs:
        low = int((n - 1) * p)
        t, high, below = _interpolated(n, values[low], values[min(low + 1, n - 1)], low, p)
        out.append((p, values[low] if t == 0 else high if t >= 0.5 else below))
    return out


def described(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> list[tuple]:
    """``(column, count, mean, std, min, max, quantiles...)`` per column; the moments come from the first scan."""
    shown = _whole_table(df, list(cols), _sorted(probs), accuracy, True)
    rows = []
    for f, c in enumerate(cols):
        if f in shown:
            r, values = shown[f]
            of = dict(_picked(r, values, _sorted(probs)))
            rows.append((c, r["__n"], r["mean"], r["std"], r["min"], r["max"], *[of[p] for p in probs]))
        else:
            rows.append((c, 0, *[None] * (4 + len(probs))))
    return rows


def _sorted(probs: Sequence[float]) -> list[float]:
    return sorted({float(p) for p in probs})


def quantile_value(df: DataFrame, col: str, prob: float, accuracy: int = ACCURACY) -> float | None:
    """One global quantile, null without values."""
    row = exact_quantiles(df, [col], [prob], accuracy=accuracy).first()
    return row["quantile"] if row else None


def approximate_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Single-pass inexact variant from mergeable sketches: returned values are members of the column."""
    data = unpivot_numeric(df, cols)
    sketch = data.groupBy("feature").agg(
        F.percentile_approx("value", [float(p) for p in probs], accuracy).alias("marks")
    )
    rows = [F.struct(F.lit(float(p)).alias("prob"), F.col("marks")[i].alias("quantile")) for i, p in enumerate(probs)]
    return sketch.select("feature", F.inline(F.array(*rows)))


def _limit(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _real(df: DataFrame, col: str) -> Column:
    """Not NaN. Only for types that know NaN, so that other filters stay plain comparisons."""
    return ~F.isnan(col) if dict(df.dtypes)[col] in ("double", "float") else F.lit(True)


def trim(df: DataFrame, col: str, prob: float, side: str = "upper") -> DataFrame:
    """Rows at or below (``upper``) or at or above (``lower``) the global quantile, which is not rounded.

    The threshold is computed once, here, and reaches the scan as a literal. Nulls and NaN go.
    """
    limit = _limit(quantile_value(df, col, prob))
    return df.filter(F.col(col) <= limit) if side == "upper" else df.filter((F.col(col) >= limit) & _real(df, col))


def trim_within(df: DataFrame, col: str, prob: float, by: Sequence[str]) -> DataFrame:
    """Rows at or below the quantile of their own group."""
    limits = exact_quantiles(df, [col], [prob], by).select(*by, F.col("quantile").alias("__limit"))
    kept = lookup_join(df, materialise(limits, "limits"), by, "inner")
    return kept.filter(F.col(col) <= F.col("__limit")).select(*df.columns)


def band(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Rows strictly between two global quantiles, both taken from the same scans."""
    found = {r.prob: r["quantile"] for r in exact_quantiles(df, [col], [low, high]).collect()}
    return df.filter((F.col(col) > _limit(found.get(float(low)))) & (F.col(col) < _limit(found.get(float(high)))))
