"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: ColumnLike) -> Column:
    """The value as a double; NaN counts as missing, as no table here means anything by it."""
    x = as_column(c).cast("double")
    return F.when(~F.isnan(x), x)


def row_sum(cols: Sequence[str]) -> Column:
    """Sum across columns, a missing value counting as 0."""
    return reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in cols])


def all_zero(cols: Sequence[str]) -> Column:
    """True where every column equals 0 (a null makes the row fail the test)."""
    return reduce(and_, [F.coalesce(F.col(c) == 0, F.lit(False)) for c in cols])


def all_present(cols: Sequence[str]) -> Column:
    """True where no column is null. Plain IS NOT NULL tests, which the file scan can use."""
    return reduce(and_, [F.col(c).isNotNull() for c in cols])


def any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def zero_sum(c: ColumnLike) -> Column:
    """Sum where an empty or all-null group gives 0 instead of null."""
    return F.coalesce(F.sum(as_column(c)), F.lit(0))


def percent(part: ColumnLike, whole: ColumnLike, digits: int = 2) -> Column:
    """100 * part / whole, half-even rounding, null when the whole is 0."""
    return F.bround(F.try_divide(as_column(part) * 100.0, as_column(whole)), digits)


def week_number(day: ColumnLike, first_day: ColumnLike) -> Column:
    """1-based 7-day block counted from first_day; floors, so earlier days get 0, -1, ..."""
    gap = as_column(day) - as_column(first_day)
    return (F.floor(gap / F.lit(7)) + 1).cast("bigint")


def code_label(code: ColumnLike, labels: Mapping[int, str]) -> Column:
    """Decode an integer code; an unknown code gives null."""
    code = as_column(code)
    pairs = list(labels.items())
    out = F.when(code == pairs[0][0], F.lit(pairs[0][1]))
    for value, text in pairs[1:]:
        out = out.when(code == value, F.lit(text))
    return out


def hash_fraction(key: ColumnLike, seed: int) -> Column:
    """Value in [0, 1) fixed by (seed, key): a split that a re-run task repeats exactly. A null key
    is a key of its own."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(as_column(key).cast("string"), F.lit("\0"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def days_since(ts: ColumnLike, origin: str) -> Column:
    """Integer day offset of a timestamp from an ISO origin date."""
    return F.datediff(as_column(ts), F.lit(origin).cast("date"))


def bin_of(value: ColumnLike, lo: ColumnLike, hi: ColumnLike, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed on the right, outsiders give null."""
    value, lo, hi = as_column(value), as_column(lo), as_column(hi)
    raw = F.floor((value - lo) * F.lit(float(bins)) / (hi - lo)).cast("int")
    return F.when((value >= lo) & (value <= hi), F.least(raw, F.lit(bins - 1)))


def edge_bin_of(value: ColumnLike, edges: Sequence[float]) -> Column:
    """0-based bin for explicit rising edges; the last bin is closed on the right."""
    value = as_column(value)
    passed = reduce(add, [(value >= F.lit(e)).cast("int") for e in edges[:-1]])
    inside = (value >= F.lit(edges[0])) & (value <= F.lit(edges[-1]))
    return F.when(inside, passed - 1)


def chunk_of(position: ColumnLike, total: ColumnLike, chunks: int) -> Column:
    """0-based chunk of a 1-based position: the first (total mod chunks) chunks get one row more."""
    pos0 = as_column(position) - 1
    size = F.floor(as_column(total) / F.lit(chunks))
    extra = F.pmod(as_column(total), F.lit(chunks))
    in_long = extra * (size + 1)
    tail = extra + F.floor(F.try_divide(pos0 - in_long, size))
    return F.when(pos0 < in_long, F.floor(pos0 / (size + 1))).otherwise(tail).cast("int")
