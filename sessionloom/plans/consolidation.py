"""Consolidate the course-log star into one row per student, session, day and assessment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present
from sessionloom.operators.joins import (
    activity_assessment_merge,
    dimension_outer_merge,
    fan_out_totals,
    left_merge,
    outer_merge,
)
from sessionloom.operators.shape import levels_of, pivot_loss, pivot_sum
from sessionloom.sources.files import read_csv, read_zipped_csv
from sessionloom.sources.schemas import ACTIVITIES, SOURCES

COURSE = ["code_module", "code_presentation"]
SESSION = ["id_student", *COURSE]


def load_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven source tables as ``{name}.csv`` under one folder, or as members of one zip archive."""
    if folder.endswith(".zip"):
        tables = {name: read_zipped_csv(spark, folder, ddl, f"*{name}.csv") for name, ddl in SOURCES.items()}
        return {name: df.drop("archive", "member") for name, df in tables.items()}
    return {name: read_csv(spark, f"{folder}/{name}.csv", ddl) for name, ddl in SOURCES.items()}


def session_info(courses: DataFrame, info: DataFrame, registration: DataFrame) -> DataFrame:
    """One row per session; courses without students stay, with null student columns."""
    return dimension_outer_merge(outer_merge(info, registration), courses)


def submissions(student_assessment: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row per submission. The due date is renamed: the click log has its own ``date``."""
    return left_merge(student_assessment, assessments.withColumnRenamed("date", "due_date"))


def daily_activity(
    student_vle: DataFrame,
    vle: DataFrame,
    activities: Sequence[str] | None = tuple(ACTIVITIES),
    other: str | None = None,
) -> DataFrame:
    """One row per student, session and day with a click count per activity.

    ``activities=None`` takes the list from the site table. ``other`` names a column that gathers the
    clicks on activities outside the list and on unknown sites; without it ``activity_loss`` counts them.

    Clicks are summed per site and day before the site table is joined, so the join sees the
    collapsed log and a heavy student has at most one row per site and day.
    """
    levels = activity_levels(vle) if activities is None else activities
    per_site = _site_days(student_vle.filter(all_present([*SESSION, "date"])), vle)
    return pivot_sum(per_site, [*SESSION, "date"], "activity_type", "sum_click", levels, other)


def _site_days(student_vle: DataFrame, vle: DataFrame) -> DataFrame:
    per_site = student_vle.groupBy(*SESSION, "id_site", "date").agg(F.sum("sum_click").alias("sum_click"))
    return left_merge(per_site, vle.select("id_site", *COURSE, "activity_type"))


def activity_levels(vle: DataFrame) -> list[str]:
    """The activities of the site table, in order."""
    return levels_of(vle, "activity_type")


def activity_loss(
    student_vle: DataFrame, vle: DataFrame, activities: Sequence[str] = tuple(ACTIVITIES)
) -> DataFrame:
    """One row: clicks in all, in listed activities, in others, on unknown sites, and without a session key."""
    return pivot_loss(_site_days(student_vle, vle), [*SESSION, "date"], "activity_type", "sum_click", activities)


def consolidated(
    tables: dict[str, DataFrame],
    activities: Sequence[str] | None = tuple(ACTIVITIES),
    other: str | None = None,
) -> DataFrame:
    """The final table: daily activity outer-merged with submissions, plus session attributes.

    ``activities`` and ``other`` as in ``daily_activity``.
    """
    levels = activity_levels(tables["vle"]) if activities is None else list(activities)
    daily = daily_activity(tables["studentVle"], tables["vle"], levels, other)
    subs = submissions(tables["studentAssessment"], tables["assessments"])
    counters = [*levels, *([other] if other else [])]
    merged = activity_assessment_merge(daily, subs, SESSION, "date", "date_submitted", counters)
    info = session_info(tables["courses"], tables["studentInfo"], tables["studentRegistration"])
    return left_merge(merged, info.filter(all_present(["id_student"])))


def dayless_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Per-session totals of the day-less many-to-many merge of clicks and submissions."""
    subs = submissions(tables["studentAssessment"], tables["assessments"])
    return fan_out_totals(tables["studentVle"], subs, SESSION, ["sum_click"], ["score"])
