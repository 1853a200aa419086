"""Queries: the flat daily log, one wide numeric-coded row per student, session and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.plans import flat_log
from sessionloom.plans import stand_ins as v
from sessionloom.plans.features import DESCRIBED, describe_sql
from sessionloom.sources.schemas import STUDENT_ATTRIBUTES

# Coded student attributes over the customer table, as SQL that both engines read.
_CODED = {
    "gender": "c_custkey % 2",
    "region": "c_nationkey",
    "highest_education": "c_custkey % 5",
    "imd_band": "c_custkey % 10",
    "age_band": "c_custkey % 3",
    "num_of_prev_attempts": "c_custkey % 4",
    "disability": "c_custkey % 7 % 2",
    "studied_credits": "c_custkey % 12 * 30",
    "final_result": "c_nationkey % 4",
}
_MODULE = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(v.MODULES))
_PEOPLE = (
    f"c_custkey AS id_student, CAST(CASE c_mktsegment {_MODULE} END AS DOUBLE) AS code_module, "
    + ", ".join(f"CAST({_CODED[a]} AS DOUBLE) AS {a}" for a in STUDENT_ATTRIBUTES)
)


def log(spark, sf):
    """Collapsed days with coded attributes; a day's score is its best purchase."""
    days = v.event_days(spark, sf).groupBy("id_student", "code_presentation", "date").agg(
        *[F.sum(F.when(F.col("activity_type") == a, F.col("sum_click")).otherwise(0)).cast("double").alias(a) for a in v.ACTIVITY],
        F.max("score").alias("score"),
    )
    coded = days.withColumns({c: F.col(c).cast("double") for c in ("code_presentation", "date")})
    return coded.join(v.table(spark, sf, "customer").selectExpr(*_split(_PEOPLE)), "id_student")


def _split(select: str) -> list[str]:
    return [f"{part}" for part in select.split(", ")]


def flat_snapshot(spark, sf):
    return flat_log.snapshot(log(spark, sf), v.ACTIVITY).withColumns({a: F.round(a, 6) for a in STUDENT_ATTRIBUTES})


def flat_courses(spark, sf):
    return flat_log.sessions_per_course(flat_log.snapshot(log(spark, sf), v.ACTIVITY))


def flat_summary(spark, sf):
    snap = flat_log.snapshot(log(spark, sf), v.ACTIVITY)
    return flat_log.interaction_summary(v.materialise(snap, "snapshot"), v.ACTIVITY)


def flat_coverage(spark, sf):
    return flat_log.score_coverage(log(spark, sf))


def flat_regularity(spark, sf):
    rows = flat_log.with_regularity(log(spark, sf))
    shown = ["gap_mean", "gap_std", "gap_cv", "active_days_per_week_mean", "active_days_per_week_sd"]
    return rows.select(*flat_log.SESSION, "date", "week", "gaps", *[F.round(c, 6).alias(c) for c in shown])


QUERIES = {
    f.__name__: f
    for f in (
        v.display(flat_summary, DESCRIBED, even=True),
        flat_snapshot, flat_courses, flat_coverage, flat_regularity,
    )
}

_DAYS = f"""
SELECT id_student, CAST(code_presentation AS DOUBLE) AS code_presentation, CAST(date AS DOUBLE) AS date,
  {', '.join(f"CAST(count(*) FILTER (WHERE activity_type = '{a}') AS DOUBLE) AS {a}" for a in v.ACTIVITY)}, max(score) AS score
FROM ({v.EVENT_DAYS}) GROUP BY ALL"""
_LOG = f"SELECT * FROM ({_DAYS}) JOIN (SELECT {_PEOPLE} FROM customer) USING (id_student)"
_SNAP = f"""
SELECT id_student, code_module, code_presentation, {', '.join(f'sum({a}) AS {a}' for a in v.ACTIVITY)},
       {', '.join(f'round(avg({a}), 6) AS {a}' for a in STUDENT_ATTRIBUTES)}
FROM ({_LOG}) GROUP BY id_student, code_module, code_presentation"""
_NUMBERS = lambda codes: ", ".join(f"({c}::DOUBLE)" for c in codes)
_WEEKS = f"""
SELECT *, CAST(floor((date - min(date) OVER (PARTITION BY code_presentation)) / 7) + 1 AS BIGINT) AS week FROM ({_LOG})"""
_KEYS = ", ".join(flat_log.SESSION)

ORACLE = {
    "flat_snapshot": _SNAP,
    "flat_courses": f"""
SELECT m.code_module, p.code_presentation, count(s.id_student) AS n
FROM (VALUES {_NUMBERS(flat_log.MODULE_CODES)}) m(code_module), (VALUES {_NUMBERS(flat_log.PRESENTATION_CODES)}) p(code_presentation)
LEFT JOIN ({_SNAP}) s ON s.code_module = m.code_module AND s.code_presentation = p.code_presentation GROUP BY ALL""",
    "flat_summary": describe_sql(
        f"SELECT {' + '.join(v.ACTIVITY)} AS total_interactions FROM ({_SNAP})", ["total_interactions"]
    ),
    "flat_coverage": f"""
SELECT code_module, code_presentation, count(*) AS all_rows, count(score) AS scored_rows,
       count(DISTINCT id_student) AS entities, count(DISTINCT CASE WHEN score IS NOT NULL THEN id_student END) AS entities_scored,
       count(DISTINCT id_student) - count(DISTINCT CASE WHEN score IS NOT NULL THEN id_student END) AS entities_unscored,
       min(date) AS first_day, max(date) AS last_day,
       min(CASE WHEN score IS NOT NULL THEN date END) AS first_scored_day,
       max(CASE WHEN score IS NOT NULL THEN date END) AS last_scored_day
FROM ({_LOG}) GROUP BY code_module, code_presentation""",
    "flat_regularity": f"""
WITH w AS ({_WEEKS}),
g AS (SELECT {_KEYS}, count(gap) AS gaps, avg(gap) AS gap_mean, stddev_samp(gap) AS gap_std
      FROM (SELECT *, date - lag(date) OVER (PARTITION BY {_KEYS} ORDER BY date) AS gap FROM w) GROUP BY ALL),
k AS (SELECT {_KEYS}, avg(days) AS m, stddev_samp(days) AS s
      FROM (SELECT {_KEYS}, week, count(DISTINCT date) AS days FROM w GROUP BY ALL) GROUP BY {_KEYS})
SELECT {_KEYS}, date, week, gaps, round(gap_mean, 6) AS gap_mean, round(gap_std, 6) AS gap_std,
       round(gap_std / nullif(gap_mean, 0), 6) AS gap_cv, round(m, 6) AS active_days_per_week_mean, round(s, 6) AS active_days_per_week_sd
FROM w JOIN g USING ({_KEYS}) JOIN k USING ({_KEYS})""",
}
