"""Per-entity features: session snapshot, week index, activity regularity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, row_sum, week_number, zero_sum
from sessionloom.operators.joins import group_lookup


def session_snapshot(
    flat: DataFrame, keys: Sequence[str], counters: Sequence[str], attributes: Sequence[str], texts: Sequence[str] = ()
) -> DataFrame:
    """One row per entity session: counters summed, constant attributes averaged, in one pass.

    Constant text attributes (``texts``) keep their value, the smallest where a session has several;
    nulls are passed over, and a session without any value keeps null.
    """
    return (
        flat.filter(all_present(keys))
        .groupBy(*keys)
        .agg(
            *[zero_sum(c).alias(c) for c in counters],
            *[F.avg(c).alias(c) for c in attributes],
            *[F.min(c).alias(c) for c in texts],
        )
    )


def with_total(df: DataFrame, counters: Sequence[str], name: str = "total_interactions") -> DataFrame:
    return df.withColumn(name, row_sum(counters))


def first_days(df: DataFrame, group: Sequence[str], day: str) -> DataFrame:
    return df.filter(all_present(group)).groupBy(*group).agg(F.min(day).alias("first_day"))


def with_week(df: DataFrame, group: Sequence[str], day: str, name: str = "week") -> DataFrame:
    """Week index counted from the first day of the group. The minimum is a partial aggregate, so
    a group holding most of the log never has to pass through one window task."""
    tagged = group_lookup(df, first_days(df, group, day), group)
    return tagged.withColumn(name, week_number(day, "first_day")).drop("first_day")


def with_rebased_day(df: DataFrame, group: Sequence[str], day: str, name: str = "day_rebased") -> DataFrame:
    """Day counted from the first day of the group."""
    tagged = group_lookup(df, first_days(df, group, day), group)
    return tagged.withColumn(name, F.col(day) - F.col("first_day")).drop("first_day")


def _day_steps(df: DataFrame, keys: Sequence[str], day: str, *more: str) -> DataFrame:
    """Rows per (entity, day) with the step from the entity's previous active day.

    The log collapses before the window, so the window holds one row per active day however many
    events an entity has.
    """
    days = df.filter(all_present([*keys, *more, day])).groupBy(*keys, *more, day).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.lag(day).over(Window.partitionBy(*keys).orderBy(day))
    return days.withColumn("step", (F.col(day) - earlier).cast("bigint"))


def _gap_columns() -> list[Column]:
    """Gap statistics from the row count, the sum of steps and the sum of squared steps.

    Events on one day are gaps of 0, consecutive active days one gap each. The sums are integers,
    so the variance loses nothing to cancellation.
    """
    exact = lambda c: c.cast("decimal(19,0)")
    gaps = F.col("n") - 1
    number = gaps.cast("double")
    spread = exact(gaps) * exact(F.col("squares")) - exact(F.col("span")) * exact(F.col("span"))
    variance = F.when(gaps > 1, spread.cast("double") / F.nullif(number * (number - 1), F.lit(0.0)))
    mean = F.when(gaps > 0, F.col("span") / F.nullif(number, F.lit(0.0)))
    return [
        gaps.alias("gaps"),
        mean.alias("gap_mean"),
        F.sqrt(variance).alias("gap_std"),
        F.try_divide(F.sqrt(variance), F.nullif(mean, F.lit(0.0))).alias("gap_cv"),
    ]


def _step_sums() -> list[Column]:
    step = F.col("step")
    return [F.sum("n").alias("n"), zero_sum(step).alias("span"), zero_sum(step * step).alias("squares")]


def gap_metrics(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Number, mean, sample sd and coefficient of variation of the gaps between an entity's events
    in day order. Fewer than two gaps give a null sd; a mean gap of 0 gives a null variation."""
    return _day_steps(df, keys, day).groupBy(*keys).agg(*_step_sums()).select(*keys, *_gap_columns())


def weekly_consistency(df: DataFrame, keys: Sequence[str], day: str, week: str) -> DataFrame:
    """Mean and sample sd over an entity's active weeks of its distinct active days."""
    active = df.filter(all_present([*keys, week, day])).select(*keys, week, day).distinct()
    per_week = active.groupBy(*keys, week).agg(F.count(F.lit(1)).alias("days"))
    return per_week.groupBy(*keys).agg(*_week_columns())


def _week_columns() -> list[Column]:
    return [
        F.avg("days").alias("active_days_per_week_mean"),
        F.stddev_samp("days").alias("active_days_per_week_sd"),
    ]


def regularity_metrics(df: DataFrame, keys: Sequence[str], day: str, week: str) -> DataFrame:
    """Gap metrics and weekly consistency together from one collapse of the log.

    After the shuffle on the entity for the window, the week and entity totals need no other.
    """
    weeks = (
        _day_steps(df, keys, day, week)
        .groupBy(*keys, week)
        .agg(*_step_sums(), F.count(F.lit(1)).alias("days"))
    )
    totals = weeks.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "span", "squares")], *_week_columns()
    )
    return totals.select(
        *keys, *_gap_columns(), "active_days_per_week_mean", "active_days_per_week_sd"
    )


def with_entity_metric(df: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put per-entity metrics back on every row of the entity."""
    return group_lookup(df, metrics, keys)
