"""Queries: consolidation and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.operators import joins
from sessionloom.plans import stand_ins as v


def session_daily_pivot(spark, sf):
    return v.daily(spark, sf)


def info_outer_merge(spark, sf):
    summary = v.event_days(spark, sf).groupBy("id_student").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )
    return joins.outer_merge(v.students(spark, sf).select("id_student", "code_module", "region"), summary)


def course_outer_merge(spark, sf):
    log = v.event_days(spark, sf).select("event_id", "id_student", "date", "activity_type")
    return joins.dimension_outer_merge(log, v.students(spark, sf).select("id_student", "code_module", "region"))


def fact_dim_left_merge(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_quantity"
    )
    return joins.left_merge(lines, v.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"))


def many_to_many_merge(spark, sf):
    totals = joins.fan_out_totals(
        v.event_days(spark, sf), v.submissions(spark, sf).withColumnRenamed("score", "mark"),
        ["id_student"], ["value"], ["mark"],
    )
    return totals.withColumns({c: F.round(c, 2) for c in ("sum_value", "sum_mark")})


def _activity_assessment(spark, sf):
    return joins.activity_assessment_merge(
        v.student_days(spark, sf), v.submissions(spark, sf), ["id_student"], "date", "date_submitted", v.ACTIVITY
    )


def activity_assessment_merge(spark, sf):
    return _activity_assessment(spark, sf)


def consolidated_final(spark, sf):
    return joins.left_merge(_activity_assessment(spark, sf), v.students(spark, sf))


def join_invariants(spark, sf):
    subs = v.submissions(spark, sf).withColumnRenamed("date_submitted", "date")
    return joins.join_invariants(v.student_days(spark, sf), subs, ["id_student", "date"])


QUERIES = {
    f.__name__: f
    for f in (
        session_daily_pivot, info_outer_merge, course_outer_merge, fact_dim_left_merge,
        many_to_many_merge, activity_assessment_merge, consolidated_final, join_invariants,
    )
}

_ACTIVITY_LIST = ", ".join(v.ACTIVITY)
_FILLED = ", ".join(f"COALESCE(d.{a}, 0) AS {a}" for a in v.ACTIVITY)
_MERGED = f"""
SELECT COALESCE(d.id_student, s.id_student) AS id_student, COALESCE(d.date, s.date_submitted) AS date,
       {_FILLED}, s.id_assessment, s.score
FROM ({v.STUDENT_DAYS}) d FULL OUTER JOIN ({v.SUBMISSIONS}) s
  ON d.id_student = s.id_student AND d.date = s.date_submitted"""

ORACLE = {
    "session_daily_pivot": f"""
SELECT id_student, code_module, code_presentation, date, {_ACTIVITY_LIST} FROM ({v.DAILY})""",
    "info_outer_merge": f"""
SELECT COALESCE(s.id_student, e.id_student) AS id_student, code_module, region, n_events, first_day, last_day
FROM ({v.STUDENTS}) s FULL OUTER JOIN (
  SELECT id_student, count(*) AS n_events, min(date) AS first_day, max(date) AS last_day
  FROM ({v.EVENT_DAYS}) GROUP BY id_student) e ON s.id_student = e.id_student""",
    "course_outer_merge": f"""
SELECT COALESCE(s.id_student, e.id_student) AS id_student, event_id, date, activity_type, code_module, region
FROM ({v.EVENT_DAYS}) e FULL OUTER JOIN ({v.STUDENTS}) s ON s.id_student = e.id_student""",
    "fact_dim_left_merge": """
SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, l_quantity, p_brand, p_size
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "many_to_many_merge": f"""
SELECT e.id_student, count(DISTINCT event_id) AS left_rows, count(DISTINCT id_assessment) AS right_rows,
       count(*) AS merged_rows,
       round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE), 2) AS sum_value,
       round(CAST(sum(CAST(s.score AS DECIMAL(18, 2))) AS DOUBLE), 2) AS sum_mark
FROM ({v.EVENT_DAYS}) e LEFT JOIN ({v.SUBMISSIONS}) s ON e.id_student = s.id_student
GROUP BY e.id_student""",
    "activity_assessment_merge": _MERGED,
    "consolidated_final": f"SELECT m.*, s.* EXCLUDE (id_student) FROM ({_MERGED}) m LEFT JOIN ({v.STUDENTS}) s USING (id_student)",
    "join_invariants": f"""
WITH d AS ({v.STUDENT_DAYS}), s AS (SELECT * FROM ({v.SUBMISSIONS})),
o AS (SELECT d.id_student AS l, s.id_student AS r FROM d FULL OUTER JOIN s
      ON d.id_student = s.id_student AND d.date = s.date_submitted)
SELECT (SELECT count(*) FROM d) AS left_rows, (SELECT count(*) FROM s) AS right_rows,
       count(*) AS outer_rows,
       count(*) FILTER (WHERE r IS NULL) AS left_unmatched,
       count(*) FILTER (WHERE l IS NULL) AS right_unmatched,
       (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY id_student, date HAVING count(*) > 1)) AS left_dup_keys,
       (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY id_student, date_submitted HAVING count(*) > 1)) AS right_dup_keys,
       9 AS output_columns
FROM o""",
}
