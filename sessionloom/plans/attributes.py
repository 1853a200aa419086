"""Queries: text attributes, lookups and merges with hot keys, distinct counts that roll up."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.operators import encode, features, joins, profile, sketches
from sessionloom.plans import stand_ins as v
from sessionloom.plans.features import correlation_sql

TEXTS = ["nation", "segment", "name"]


def text_students(spark, sf):
    """Students with text attributes; one nation is missing, names are all distinct."""
    nations = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    people = joins.left_merge(v.table(spark, sf, "customer"), nations)
    return people.select(
        F.col("c_custkey").alias("id_student"),
        F.when(F.col("c_nationkey") != 7, F.col("n_name")).alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("name"),
    )


def encode_attributes(spark, sf):
    return encode.encode(text_students(spark, sf), TEXTS)


def snapshot_text(spark, sf):
    """The session snapshot with the text attributes kept as text."""
    daily = joins.left_merge(v.daily(spark, sf, attributes=True), text_students(spark, sf))
    snap = features.session_snapshot(daily, v.SESSION, v.ACTIVITY, v.ATTRIBUTES, TEXTS)
    return snap.withColumns({a: F.round(a, 6) for a in v.ATTRIBUTES})


def text_correlation(spark, sf):
    """Correlations of the snapshot's counters with the codes of its text attributes."""
    coded = encode.encode(snapshot_text(spark, sf), TEXTS[:2])
    return profile.correlation_matrix(coded, [*v.ACTIVITY, "nation_code", "segment_code"])


def lookup_split(spark, sf):
    """The first day of each event type on every row, five hot keys salted; then counted by the same key."""
    log = v.event_days(spark, sf).select("event_id", "activity_type", "date", "id_student")
    first = log.groupBy("activity_type").agg(F.min("date").alias("first_day"))
    tagged = joins.group_lookup(log, first, ["activity_type"], split=True)
    return tagged.groupBy("activity_type", "first_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("date") - F.col("first_day")).alias("days_since_first")
    )


def many_to_many_rows(spark, sf):
    """All pairs of a student's events and submissions; the heaviest students are laid out as grids."""
    log = v.event_days(spark, sf).select("id_student", "event_id", "activity_type")
    subs = v.submissions(spark, sf).select("id_student", "id_assessment")
    return joins.many_to_many_rows(log, subs, ["id_student"], parts=2000)


def sketched_distinct(spark, sf):
    """Distinct students per presentation and week: the exact count, and whether the sketches of the days,
    rolled up, come within their error of it."""
    keys = ["code_presentation", "date"]
    log = v.event_days(spark, sf).select(*keys, "id_student")
    week = (F.floor(F.col("date") / 7)).cast("int")
    rolled = sketches.roll_up(
        sketches.daily_sketches(log, keys, "id_student"), {"code_presentation": F.col("code_presentation"), "week": week}
    )
    exact = profile.distinct_count(log.withColumn("week", week), ["code_presentation", "week"], "id_student", "students")
    both = exact.join(sketches.estimated(rolled), ["code_presentation", "week"])
    return both.select(
        "code_presentation", "week", "students",
        sketches.within_error(F.col("estimate"), F.col("students")).alias("within_error"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        v.display(text_correlation, {"r": 6}),
        encode_attributes, snapshot_text, lookup_split, many_to_many_rows, sketched_distinct,
    )
}

_TEXT_STUDENTS = """
SELECT c_custkey AS id_student, CASE WHEN c_nationkey <> 7 THEN n_name END AS nation, c_mktsegment AS segment, c_name AS name
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""


def _code(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END AS {c}_code"


_SNAPSHOT = f"""
SELECT s.* REPLACE ({', '.join(f'round({a}, 6) AS {a}' for a in v.ATTRIBUTES)}), nation, segment, name
FROM ({v.SESSIONS}) s LEFT JOIN ({_TEXT_STUDENTS}) USING (id_student)"""

ORACLE = {
    "encode_attributes": f"SELECT *, {', '.join(map(_code, TEXTS))} FROM ({_TEXT_STUDENTS})",
    "snapshot_text": _SNAPSHOT,
    "text_correlation": correlation_sql(
        f"SELECT *, {', '.join(map(_code, TEXTS[:2]))} FROM ({_SNAPSHOT})", [*v.ACTIVITY, "nation_code", "segment_code"]
    ),
    "lookup_split": f"""
SELECT activity_type, first_day, count(*) AS n, CAST(sum(date - first_day) AS BIGINT) AS days_since_first
FROM (SELECT *, min(date) OVER (PARTITION BY activity_type) AS first_day FROM ({v.EVENT_DAYS})) GROUP BY ALL""",
    "many_to_many_rows": f"""
SELECT e.id_student, event_id, activity_type, id_assessment
FROM ({v.EVENT_DAYS}) e LEFT JOIN ({v.SUBMISSIONS}) s ON e.id_student = s.id_student""",
    "sketched_distinct": f"""
SELECT code_presentation, CAST(floor(date / 7) AS INTEGER) AS week, count(DISTINCT id_student) AS students, TRUE AS within_error
FROM ({v.EVENT_DAYS}) GROUP BY ALL""",
}
