"""Checks on the merged log: score coverage, duplicate days, submissions without activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, all_zero
from sessionloom.operators.joins import group_lookup, id_difference, lookup_join, semi_members
from sessionloom.operators.profile import distinct_count
from sessionloom.sources.scratch import materialise


def multi_assessment_days(df: DataFrame, keys: Sequence[str], assessment: str) -> DataFrame:
    """Entity-days with more than one distinct assessment."""
    return distinct_count(df, keys, assessment, "assessments").filter(F.col("assessments") > 1)


def inactive_submissions(merged: DataFrame, activity_cols: Sequence[str], score: str) -> DataFrame:
    """Scored submissions on days with no activity at all."""
    return merged.filter(all_zero(activity_cols) & F.col(score).isNotNull())


def score_coverage(df: DataFrame, session: Sequence[str], entity: str, day: str, score: str) -> DataFrame:
    """Per session: rows, scored rows, entities, and the day range of all and of scored rows.

    Rows collapse per entity first, so a session holding most of the log is combined in parts.
    """
    return session_coverage(entity_coverage(df, [*session, entity], day, score), session)


def entity_coverage(df: DataFrame, keys: Sequence[str], day: str, score: str) -> DataFrame:
    """The part of ``score_coverage`` that reads the log, one row per key. Session attributes that the
    log lacks are joined to this, not to the log, so a hot entity is one row in that join."""
    scored_day = F.when(F.col(score).isNotNull(), F.col(day))
    return df.filter(all_present(list(keys))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(score).alias("scored"),
        F.min(day).alias("lo"),
        F.max(day).alias("hi"),
        F.min(scored_day).alias("s_lo"),
        F.max(scored_day).alias("s_hi"),
    )


def session_coverage(per_entity: DataFrame, session: Sequence[str]) -> DataFrame:
    return per_entity.filter(all_present(list(session))).groupBy(*session).agg(
        F.sum("rows").alias("all_rows"),
        F.sum("scored").alias("scored_rows"),
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("scored") > 0).alias("entities_scored"),
        F.count_if(F.col("scored") == 0).alias("entities_unscored"),
        F.min("lo").alias("first_day"),
        F.max("hi").alias("last_day"),
        F.min("s_lo").alias("first_scored_day"),
        F.max("s_hi").alias("last_scored_day"),
    )


def scored_ids(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull()).select(*keys).distinct()


def unscored_ids(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Ids that never received a score."""
    return id_difference(df, scored_ids(df, keys, score), keys)


def rows_of_scored_ids(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """All rows of the ids that received a score at some point."""
    return semi_members(df, scored_ids(df, keys, score), keys)


def last_day_rows(df: DataFrame, session: Sequence[str], day: str) -> DataFrame:
    """Rows on the last day of their session."""
    last = df.filter(all_present(session)).groupBy(*session).agg(F.max(day).alias("__last"))
    return group_lookup(df, last, session).filter(F.col(day) == F.col("__last")).drop("__last")


def last_days(df: DataFrame, keys: Sequence[str], day: str, score: str) -> DataFrame:
    """The part of ``last_day_scored`` that reads the log: per key the last day and the scored rows. Session
    attributes that the log lacks are joined to this, not to the log."""
    return df.filter(all_present(list(keys))).groupBy(*keys).agg(
        F.max(day).alias("__seen"), F.count(score).alias("__scored")
    )


def last_day_members(per_entity: DataFrame, session: Sequence[str]) -> DataFrame:
    """The rows of ``last_days`` that are scored and seen on the last day of their session."""
    stored = materialise(per_entity.filter(all_present(list(session))), "entities")
    last = stored.groupBy(*session).agg(F.max("__seen").alias("__last"))
    kept = group_lookup(stored, last, session)
    return kept.filter((F.col("__scored") > 0) & (F.col("__seen") == F.col("__last"))).drop("__scored", "__seen")


def rows_of_members(df: DataFrame, members: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """The log's rows of those members on that day, with the members' other columns."""
    rows = lookup_join(df, materialise(members, "members"), keys, "inner")
    return rows.filter(F.col(day) == F.col("__last")).drop("__last")


def last_day_scored(df: DataFrame, session: Sequence[str], entity: str, day: str, score: str) -> DataFrame:
    """Rows on the session's last day that belong to an id scored in that session.

    One collapse to (session, id) gives both the last day and who is scored; the ids that qualify
    are then looked up on the rows.
    """
    keys = [*session, entity]
    members = last_day_members(last_days(df, keys, day, score), session)
    return rows_of_members(df, members, keys, day).select(*df.columns)


def score_order_check(df: DataFrame, keys: Sequence[str], day: str, score: str) -> DataFrame:
    """Per id with scored and unscored rows: do all unscored days come before the scored ones?"""
    scored = F.col(score).isNotNull()
    return (
        df.filter(all_present(keys))
        .groupBy(*keys)
        .agg(
            F.max(F.when(~scored, F.col(day))).alias("last_unscored_day"),
            F.min(F.when(scored, F.col(day))).alias("first_scored_day"),
        )
        .filter(F.col("first_scored_day").isNotNull())
        .withColumn(
            "unscored_precede_scored",
            F.coalesce(F.col("last_unscored_day") < F.col("first_scored_day"), F.lit(True)),
        )
    )


def busiest_entity(df: DataFrame, key: str):
    """Key with the most rows (smallest key on a tie), as a scalar subquery."""
    counts = df.filter(all_present([key])).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(key, F.struct(-F.col("n"), F.col(key)))).scalar()


def entity_timeline(df: DataFrame, key: str, value, order_by: Sequence[str]) -> DataFrame:
    """All rows of one entity in order. ``value`` may be a literal or a scalar subquery."""
    return df.filter(F.col(key) == value).orderBy(*order_by)
