"""Merges. All are equi-joins; the variants differ in grain and in how a hot key is handled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, any_null
from sessionloom.operators.shape import fill_zero, shared_columns
from sessionloom.sources.scratch import materialise, stored_bytes

# Lower bound on the number of parts a skewed side is cut into.
MIN_PARTS = 200


def _merge(left: DataFrame, right: DataFrame, keys: Sequence[str] | None, how: str, null_safe: bool) -> DataFrame:
    keys = list(keys or shared_columns(left, right))
    if not null_safe:
        return left.join(right, keys, how)
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, same, how).select(
        *[F.coalesce(k, f"__{k}").alias(k) for k in keys],
        *[c for c in left.columns if c not in keys],
        *[c for c in right.columns if c not in keys],
    )


def outer_merge(
    left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None, null_safe: bool = False
) -> DataFrame:
    """Full outer merge of two tables that are unique on the keys (natural keys by default).

    With ``null_safe`` a missing key matches a missing key; otherwise it matches nothing.
    """
    return _merge(left, right, keys, "full_outer", null_safe)


def left_merge(
    left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None, null_safe: bool = False
) -> DataFrame:
    """Left merge on the natural keys. Catalyst broadcasts the right side when its size is below the
    threshold; otherwise AQE cuts a skewed left partition into several tasks, unless an aggregate on the
    same keys follows (then merge with ``lookup_join``)."""
    return _merge(left, right, keys, "left", null_safe)


def dimension_outer_merge(
    fact: DataFrame, dimension: DataFrame, keys: Sequence[str] | None = None
) -> DataFrame:
    """Full outer merge of a fact with a dimension that has one row per key.

    A full outer join would always shuffle the fact, and one popular key would land in one task.
    The same rows come from the left join plus the dimension rows no fact refers to.
    """
    keys = list(keys or shared_columns(fact, dimension))
    used = fact.select(*keys).distinct()
    unused = dimension.join(used, keys, "left_anti")
    return fact.join(dimension, keys, "left").unionByName(unused, allowMissingColumns=True)


def _row_mark(df: DataFrame) -> Column:
    """Tells rows apart, equal ones by the task that holds them. It depends on nothing that a repeated task
    could see in another order, so a row keeps its salt when a lost task runs again."""
    return F.xxhash64(*[F.col(c) for c in df.columns], F.spark_partition_id())


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MIN_PARTS)


def hot_keys(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Written table of the keys that hold more than 1/parts of the rows, with the salts each needs.

    At most ``parts`` keys can be hot. Keys with a null part are in it too: they match nothing, but a
    shuffle would send them all to one task.
    """
    parts = _parts(df, parts)
    total = df.agg(F.count(F.lit(1))).scalar()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    salts = F.ceil(F.col("__rows") * parts / total).cast("int").alias("__salts")
    return materialise(per_key.filter(F.col("__rows") * parts > total).select(*keys, salts), "hot_keys")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    parts: int | None = None,
    salt_by: Column | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left, left_semi or inner join that spreads the rows of a hot left key over many tasks.

    With ``parts`` the number of shuffle partitions, a key holding more than 1/parts of the left
    rows is hot and gets one salt per 1/parts share, so each (key, salt) is about one ordinary
    partition. At most ``parts`` keys can be hot and they get at most 2 * parts salts together:
    that bounds both the broadcast hot list and the repeated right rows. Rows with a null key
    match nothing and are spread as well. ``salt_by`` tells left rows apart (default: all left
    columns, and for equal rows the task that holds them).
    """
    keys = list(keys)
    parts = _parts(left, parts)
    hot = (hot_keys(left, keys, parts) if hot is None else hot).filter(all_present(keys))
    marker = _row_mark(left) if salt_by is None else F.xxhash64(salt_by)
    spread = F.when(any_null(keys), F.lit(parts)).otherwise(F.coalesce("__salts", F.lit(1)))
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    salted_left = (
        left.withColumn("__mark", marker)
        .join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.pmod("__mark", spread).cast("int"))
        .drop("__salts", "__mark")
    )
    salted_right = (
        right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    )
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")


_UNITS = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def broadcast_limit(spark) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes, negative where broadcasts are off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(number) << _UNITS[text[len(number):] or "b"]


def lookup_join(
    df: DataFrame, stored: DataFrame, keys: Sequence[str], how: str = "left", split: bool | None = None
) -> DataFrame:
    """Join a written per-group table onto the rows (left, inner or left_semi).

    Where its files are below ``spark.sql.autoBroadcastJoinThreshold`` Catalyst broadcasts it and no row
    moves. Otherwise the rows per key are counted and hot keys are salted: AQE alone would not cut them
    where an aggregate on the key follows. ``split`` overrides the size check.
    """
    keys = list(keys)
    if split is None:
        split = stored_bytes(stored) > broadcast_limit(df.sparkSession)
    if not split:
        return df.join(stored, keys, how)
    hot = hot_keys(df, keys)
    return df.join(stored, keys, how) if hot.isEmpty() else salted_join(df, stored, keys, how, hot=hot)


def group_lookup(df: DataFrame, stats: DataFrame, keys: Sequence[str], split: bool | None = None) -> DataFrame:
    """Bring a per-group statistic back onto the rows. It is computed once and written."""
    return lookup_join(df, materialise(stats, "stats"), keys, split=split)


def many_to_many_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", parts: int | None = None
) -> DataFrame:
    """Row form of the many-to-many merge (left or inner): n left and m right rows of a key give n * m rows.

    A key whose rows are more than 1/parts of the result is laid out as a grid: its left rows are cut in
    i parts and its right rows in j, every cell holds about 1/parts of the result and is a key of its
    own, and a left row is sent to the j cells of its part. At most ``parts`` keys need a grid, so its
    list is broadcast. Left rows without a partner, and with a null key, keep null right columns.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    keys = list(keys)
    parts = _parts(left, parts)
    a = left.filter(all_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    b = right.filter(all_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    sizes = materialise(a.join(b, keys), "sizes")
    made = F.col("__n").cast("double") * F.col("__m")
    cell = sizes.agg(F.greatest(F.sum(made) / parts, F.lit(1.0))).scalar()
    side = F.sqrt(F.col("__cell"))
    cut = lambda c: F.ceil(F.least(F.col(c) / side, made / F.col("__cell"))).cast("int")
    hot = sizes.withColumn("__cell", cell).filter(made > F.col("__cell"))
    grid = materialise(hot.select(*keys, cut("__n").alias("__rows"), cut("__m").alias("__cols")), "grid")

    def laid_out(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        marked = df.withColumn("__mark", _row_mark(df)).join(F.broadcast(grid), keys)
        part = F.pmod("__mark", F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return marked.withColumn(mine, part).withColumn(theirs, every).drop("__mark", "__rows", "__cols")

    cells = laid_out(left, "__rows", "__cols", "__i", "__j").join(
        laid_out(right, "__cols", "__rows", "__j", "__i"), [*keys, "__i", "__j"]
    )
    rest = left.join(F.broadcast(grid), keys, "left_anti")
    plain = salted_join(rest, right, keys, how, parts) if how == "left" else rest.join(right, keys)
    return plain.unionByName(cells.drop("__i", "__j"))


def fan_out_totals(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
) -> DataFrame:
    """Per-key totals of the many-to-many left merge, without building the merged rows.

    A key with n left and m right rows gives n * max(m, 1) merged rows; left amounts repeat
    max(m, 1) times and right amounts n times. Both sides shrink to one row per key first.
    """
    keys = list(keys)
    a = left.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("left_rows"), *[F.sum(c).alias(f"__l_{c}") for c in left_sums]
    )
    b = right.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("right_rows"), *[F.sum(c).alias(f"__r_{c}") for c in right_sums]
    )
    m = F.coalesce("right_rows", F.lit(0))
    repeat = F.greatest(m, F.lit(1))
    return a.join(b, keys, "left").select(
        *keys,
        "left_rows",
        m.alias("right_rows"),
        (F.col("left_rows") * repeat).alias("merged_rows"),
        *[(F.col(f"__l_{c}") * repeat).alias(f"sum_{c}") for c in left_sums],
        *[(F.col(f"__r_{c}") * F.col("left_rows")).alias(f"sum_{c}") for c in right_sums],
    )


def activity_assessment_merge(
    daily: DataFrame,
    submissions: DataFrame,
    keys: Sequence[str],
    day: str,
    submitted_day: str,
    activity_cols: Sequence[str],
) -> DataFrame:
    """Full outer merge of daily activity with submissions made on that day.

    Keeps submissions without activity (counters 0) and active days without submission; several
    submissions on one day give several rows. The outer join is taken as submissions-left-join-
    daily, broadcast or split, plus the days nobody submitted on. ``daily`` is written first: both
    halves then read the collapsed days and the click log itself is read once.
    """
    on = [*keys, day]
    daily = materialise(daily, "daily")
    subs = submissions.withColumnRenamed(submitted_day, day)
    with_activity = lookup_join(subs, daily, on)
    quiet_days = daily.join(subs.select(*on).distinct(), on, "left_anti")
    merged = with_activity.unionByName(quiet_days, allowMissingColumns=True)
    return fill_zero(merged, activity_cols).select(
        *on, *activity_cols, *[c for c in subs.columns if c not in on]
    )


def semi_members(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in the id set."""
    return lookup_join(df, materialise(ids.select(*keys).distinct(), "ids"), keys, "left_semi")


def id_difference(all_ids: DataFrame, minus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ids of the first table that the second lacks."""
    return all_ids.select(*keys).distinct().join(minus.select(*keys).distinct(), list(keys), "left_anti")


def join_invariants(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts a full outer merge would show, taken from per-key counts on both sides."""
    keys = list(keys)
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, keys, "full_outer").select(
        F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")
    )
    one = F.lit(1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(
        total(F.col("a")).alias("left_rows"),
        total(F.col("b")).alias("right_rows"),
        total(F.greatest("a", one) * F.greatest("b", one)).alias("outer_rows"),
        total(F.when(F.col("b") == 0, F.col("a"))).alias("left_unmatched"),
        total(F.when(F.col("a") == 0, F.col("b"))).alias("right_unmatched"),
        F.count_if(F.col("a") > 1).alias("left_dup_keys"),
        F.count_if(F.col("b") > 1).alias("right_dup_keys"),
    ).withColumn("output_columns", F.lit(len(left.columns) + len(right.columns) - len(keys)))
