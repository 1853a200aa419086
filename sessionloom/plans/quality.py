"""Queries: score coverage and merge checks."""

from __future__ import annotations

from sessionloom.operators import joins, quality
from sessionloom.plans import merges
from sessionloom.plans import stand_ins as v

COURSE = ["code_module", "code_presentation"]
LAST = ["id_student", *COURSE]


def multi_assessment_days(spark, sf):
    return quality.multi_assessment_days(
        v.submissions(spark, sf), ["id_student", "date_submitted"], "id_assessment"
    )


def inactive_submissions(spark, sf):
    return quality.inactive_submissions(merges.activity_assessment_merge(spark, sf), v.ACTIVITY, "score")


def _modules(spark, sf):
    return v.students(spark, sf).select("id_student", "code_module")


def score_coverage(spark, sf):
    log = quality.entity_coverage(v.event_days(spark, sf), ["id_student", "code_presentation"], "date", "score")
    return quality.session_coverage(joins.left_merge(log, _modules(spark, sf)), COURSE)


def scored_semi(spark, sf):
    """Rows of students with a purchase over 300 at any time."""
    log = v.event_days(spark, sf).select("event_id", "id_student", "date", "value")
    return joins.semi_members(log, log.filter("value > 300"), ["id_student"])


def unscored_ids(spark, sf):
    """Session entities without a score above 200."""
    log = v.event_days(spark, sf).selectExpr(
        "id_student", "code_presentation", "CASE WHEN score > 200 THEN score END AS score"
    )
    return quality.unscored_ids(log, ["id_student", "code_presentation"], "score")


def last_day_scored(spark, sf):
    """The module is joined to one row per student and presentation, not to the log."""
    log = v.event_days(spark, sf).select("event_id", "id_student", "code_presentation", "date", "score")
    keys = ["id_student", "code_presentation"]
    per_entity = joins.left_merge(quality.last_days(log, keys, "date", "score"), _modules(spark, sf))
    rows = quality.rows_of_members(log, quality.last_day_members(per_entity, COURSE), keys, "date")
    return rows.select("event_id", *LAST, "date", "score")


def last_day_rows(spark, sf):
    log = v.event_days(spark, sf).select("event_id", "code_presentation", "date")
    return quality.last_day_rows(log, ["code_presentation"], "date")


def score_order_check(spark, sf):
    order = quality.score_order_check(v.event_days(spark, sf), ["id_student", "code_presentation"], "date", "score")
    return joins.left_merge(order, _modules(spark, sf)).filter("code_module is not null")


def entity_timeline(spark, sf):
    log = v.clicks(spark, sf)
    busiest = quality.busiest_entity(log, "id_student")
    return quality.entity_timeline(log, "id_student", busiest, ["date", "event_id"])


QUERIES = {
    f.__name__: f
    for f in (
        multi_assessment_days, inactive_submissions, score_coverage, scored_semi, unscored_ids,
        last_day_scored, last_day_rows, score_order_check, entity_timeline,
    )
}

_ZERO = " AND ".join(f"{a} = 0" for a in v.ACTIVITY)

ORACLE = {
    "multi_assessment_days": f"""
SELECT id_student, date_submitted, count(DISTINCT id_assessment) AS assessments FROM ({v.SUBMISSIONS})
GROUP BY ALL HAVING count(DISTINCT id_assessment) > 1""",
    "inactive_submissions": f"""
SELECT * FROM ({merges.ORACLE['activity_assessment_merge']}) WHERE {_ZERO} AND score IS NOT NULL""",
    "score_coverage": f"""
WITH c AS ({v.CLICKS})
SELECT code_module, code_presentation, count(*) AS all_rows, count(score) AS scored_rows,
       count(DISTINCT id_student) AS entities,
       count(DISTINCT CASE WHEN score IS NOT NULL THEN id_student END) AS entities_scored,
       count(DISTINCT id_student) - count(DISTINCT CASE WHEN score IS NOT NULL THEN id_student END) AS entities_unscored,
       min(date) AS first_day, max(date) AS last_day,
       min(CASE WHEN score IS NOT NULL THEN date END) AS first_scored_day,
       max(CASE WHEN score IS NOT NULL THEN date END) AS last_scored_day
FROM c GROUP BY code_module, code_presentation""",
    "scored_semi": f"""
SELECT event_id, id_student, date, value FROM ({v.EVENT_DAYS})
WHERE id_student IN (SELECT user_id FROM events WHERE value > 300)""",
    "unscored_ids": f"""
SELECT id_student, code_presentation FROM ({v.EVENT_DAYS})
GROUP BY ALL HAVING count(CASE WHEN score > 200 THEN 1 END) = 0""",
    "last_day_scored": f"""
WITH c AS ({v.CLICKS}),
l AS (SELECT code_module, code_presentation, max(date) AS last_day FROM c GROUP BY ALL),
s AS (SELECT DISTINCT id_student, code_module, code_presentation FROM c WHERE score IS NOT NULL)
SELECT event_id, id_student, code_module, code_presentation, date, score
FROM c JOIN l USING (code_module, code_presentation) JOIN s USING (id_student, code_module, code_presentation)
WHERE date = last_day""",
    "last_day_rows": f"""
SELECT event_id, code_presentation, date FROM ({v.EVENT_DAYS}) JOIN (
  SELECT code_presentation, max(date) AS last FROM ({v.EVENT_DAYS}) GROUP BY 1) USING (code_presentation)
WHERE date = last""",
    "score_order_check": f"""
SELECT *, COALESCE(last_unscored_day < first_scored_day, TRUE) AS unscored_precede_scored FROM (
  SELECT id_student, code_module, code_presentation,
         max(CASE WHEN score IS NULL THEN date END) AS last_unscored_day,
         min(CASE WHEN score IS NOT NULL THEN date END) AS first_scored_day
  FROM ({v.CLICKS}) GROUP BY ALL)
WHERE first_scored_day IS NOT NULL""",
    "entity_timeline": f"""
SELECT * FROM ({v.CLICKS}) WHERE id_student = (
  SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""",
}
