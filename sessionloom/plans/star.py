"""Queries: the consolidation pipeline over seven tables in the star's own layout.

The test tables stand in for the star: customers are students of one module and all presentations,
events are clicks on a site per module, presentation and activity, orders are submissions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.operators import shape
from sessionloom.plans import consolidation
from sessionloom.plans import stand_ins as v


def _position(values: list[str], c: str):
    return F.array_position(F.array(*map(F.lit, values)), F.col(c)).cast("int")


def tables(spark, sf):
    """The seven tables by name, with the columns that ``sources.schemas`` declares."""
    customers = v.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int").alias("id_student"),
        F.col("c_mktsegment").alias("code_module"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )
    term = F.explode(F.array(*[F.lit(str(p)) for p in v.PRESENTATIONS])).alias("code_presentation")
    courses = customers.select("code_module").distinct().select("code_module", term).withColumn(
        "module_presentation_length", F.length("code_module") * 10 + F.col("code_presentation").cast("int")
    )
    number = _position(v.MODULES, "code_module") * 10 + F.col("code_presentation").cast("int")
    activity = F.explode(F.array(*map(F.lit, v.ACTIVITY))).alias("activity_type")
    vle = courses.select("code_module", "code_presentation", activity).select(
        (number * 10 + _position(v.ACTIVITY, "activity_type")).alias("id_site"),
        "code_module", "code_presentation", "activity_type",
    )
    info = customers.select("id_student", "code_module", "nation", "balance", term)
    student_info = info.filter("(id_student + cast(code_presentation as int)) % 5 <> 0").select(
        "code_module", "code_presentation", "id_student",
        F.concat(F.lit("region "), F.col("nation")).alias("region"),
        F.when(F.col("balance") > 0, "Passed").otherwise("Fail").alias("final_result"),
    )
    registration = info.filter("(id_student + cast(code_presentation as int)) % 7 <> 0").select(
        "code_module", "code_presentation", "id_student", (-F.col("nation")).alias("date_registration")
    )
    assessments = courses.select(
        number.alias("id_assessment"), "code_module", "code_presentation", F.lit("TMA").alias("assessment_type"),
        (number % 15).alias("date"), F.lit(50.0).alias("weight"),
    )
    of_student = customers.select("id_student", "code_module")
    clicks = v.event_days(spark, sf).join(of_student, "id_student").select(
        "code_module", F.col("code_presentation").cast("string").alias("code_presentation"),
        "id_student", "activity_type", "date", "sum_click",
    )
    student_vle = clicks.select(
        "code_module", "code_presentation", F.col("id_student").cast("int").alias("id_student"),
        (number * 10 + _position(v.ACTIVITY, "activity_type")).alias("id_site"), "date", "sum_click",
    )
    orders = v.submissions(spark, sf).join(of_student, "id_student").withColumn(
        "code_presentation", F.floor(F.col("date_submitted") / 15).cast("string")
    )
    student_assessment = orders.select(
        number.alias("id_assessment"), F.col("id_student").cast("int").alias("id_student"), "date_submitted",
        F.lit(0).alias("is_banked"), "score",
    )
    return {
        "courses": courses, "assessments": assessments, "vle": vle, "studentInfo": student_info,
        "studentRegistration": registration, "studentAssessment": student_assessment, "studentVle": student_vle,
    }


def star_session_info(spark, sf):
    t = tables(spark, sf)
    return consolidation.session_info(t["courses"], t["studentInfo"], t["studentRegistration"])


def star_daily_activity(spark, sf):
    t = tables(spark, sf)
    return consolidation.daily_activity(t["studentVle"], t["vle"], shape.levels_of(t["vle"], "activity_type"))


def star_consolidated(spark, sf):
    return consolidation.consolidated(tables(spark, sf), v.ACTIVITY)


def star_levels(spark, sf):
    """The final table with the activities that the site table names."""
    return consolidation.consolidated(tables(spark, sf), None)


def star_other(spark, sf):
    """Daily activity with two activities listed and the rest in a column of its own."""
    t = tables(spark, sf)
    return consolidation.daily_activity(t["studentVle"], t["vle"], LISTED, "other")


def star_activity_loss(spark, sf):
    t = tables(spark, sf)
    return consolidation.activity_loss(t["studentVle"], t["vle"], LISTED)


def star_dayless(spark, sf):
    totals = consolidation.dayless_totals(tables(spark, sf))
    return totals.withColumn("sum_score", F.round("sum_score", 2))


LISTED = v.ACTIVITY[:2]

QUERIES = {
    f.__name__: f
    for f in (
        star_session_info, star_daily_activity, star_consolidated, star_levels, star_other, star_activity_loss, star_dayless,
    )
}

_MODULE_NO = "list_position(['" + "', '".join(v.MODULES) + "'], code_module)"
_ACTIVITY_NO = "list_position(['" + "', '".join(v.ACTIVITY) + "'], activity_type)"
_NUMBER = f"CAST({_MODULE_NO} * 10 + CAST(code_presentation AS INTEGER) AS INTEGER)"
_TERMS = "(VALUES " + ", ".join(f"('{p}')" for p in v.PRESENTATIONS) + ") p(code_presentation)"
_BASE = f"""
cust AS (SELECT CAST(c_custkey AS INTEGER) AS id_student, c_mktsegment AS code_module, c_nationkey AS nation, c_acctbal AS balance
         FROM customer),
courses AS (SELECT code_module, code_presentation,
                   CAST(length(code_module) * 10 + CAST(code_presentation AS INTEGER) AS INTEGER) AS module_presentation_length
            FROM (SELECT DISTINCT code_module FROM cust), {_TERMS}),
sinfo AS (SELECT code_module, code_presentation, id_student, 'region ' || nation AS region,
                 CASE WHEN balance > 0 THEN 'Passed' ELSE 'Fail' END AS final_result
          FROM cust, {_TERMS} WHERE (id_student + CAST(code_presentation AS INTEGER)) % 5 <> 0),
reg AS (SELECT code_module, code_presentation, id_student, -nation AS date_registration
        FROM cust, {_TERMS} WHERE (id_student + CAST(code_presentation AS INTEGER)) % 7 <> 0),
info AS (SELECT * FROM sinfo FULL JOIN reg USING (code_module, code_presentation, id_student)
         FULL JOIN courses USING (code_module, code_presentation)),
daily AS (SELECT c.id_student, code_module, CAST(code_presentation AS VARCHAR) AS code_presentation, date, {v.COUNTERS}
          FROM (SELECT CAST(id_student AS INTEGER) AS id_student, code_presentation, date, activity_type, sum_click
                FROM ({v.EVENT_DAYS})) c JOIN cust USING (id_student) GROUP BY ALL)"""

ORACLE = {
    "star_session_info": f"WITH {_BASE} SELECT * FROM info",
    "star_daily_activity": f"WITH {_BASE} SELECT * FROM daily",
    "star_consolidated": f"""
WITH {_BASE},
sub0 AS (SELECT CAST(s.id_student AS INTEGER) AS id_student, code_module,
                CAST(CAST(floor(date_submitted / 15) AS INTEGER) AS VARCHAR) AS code_presentation, date_submitted, score
         FROM ({v.SUBMISSIONS}) s JOIN cust c ON s.id_student = c.id_student),
subs AS (SELECT s.*, {_NUMBER.replace('code_module', 's.code_module').replace('code_presentation', 's.code_presentation')} AS id_assessment,
                a.code_module IS NOT NULL AS known
         FROM sub0 s LEFT JOIN courses a USING (code_module, code_presentation)),
merged AS (SELECT COALESCE(d.id_student, s.id_student) AS id_student, COALESCE(d.code_module, s.code_module) AS code_module,
                  COALESCE(d.code_presentation, s.code_presentation) AS code_presentation, COALESCE(date, date_submitted) AS date,
                  {", ".join(f'COALESCE({a}, 0) AS {a}' for a in v.ACTIVITY)}, id_assessment, CASE WHEN s.id_student IS NOT NULL THEN 0 END AS is_banked,
                  score, CASE WHEN s.id_student IS NOT NULL THEN 'TMA' END AS assessment_type, CAST(id_assessment % 15 AS INTEGER) AS due_date,
                  CASE WHEN s.id_student IS NOT NULL THEN 50.0::DOUBLE END AS weight
           FROM daily d FULL JOIN subs s ON d.id_student = s.id_student AND d.code_module = s.code_module
                AND d.code_presentation = s.code_presentation AND d.date = s.date_submitted)
SELECT * FROM merged LEFT JOIN (SELECT * FROM info WHERE id_student IS NOT NULL) USING (id_student, code_module, code_presentation)""",
}

_CLICKS = f"""
SELECT CAST(id_student AS INTEGER) AS id_student, code_module, CAST(code_presentation AS VARCHAR) AS code_presentation, date,
       activity_type, sum_click
FROM ({v.EVENT_DAYS}) JOIN (SELECT c_custkey AS id_student, c_mktsegment AS code_module FROM customer) USING (id_student)"""
_IN_LIST = ", ".join(f"'{a}'" for a in LISTED)
ORACLE |= {
    "star_levels": ORACLE["star_consolidated"],
    "star_other": f"""
SELECT id_student, code_module, code_presentation, date,
       {', '.join(f"count(*) FILTER (WHERE activity_type = '{a}') AS {a}" for a in LISTED)},
       count(*) FILTER (WHERE activity_type NOT IN ({_IN_LIST})) AS other
FROM ({_CLICKS}) GROUP BY ALL""",
    "star_activity_loss": f"""
SELECT count(*) AS total, count(*) FILTER (WHERE activity_type IN ({_IN_LIST})) AS listed,
       count(*) FILTER (WHERE activity_type NOT IN ({_IN_LIST})) AS unlisted, CAST(0 AS BIGINT) AS no_level, CAST(0 AS BIGINT) AS no_key
FROM ({_CLICKS})""",
    "star_dayless": f"""
WITH cust AS (SELECT c_custkey AS id_student, c_mktsegment AS code_module FROM customer),
a AS (SELECT id_student, code_module, code_presentation, count(*) AS left_rows FROM ({_CLICKS}) GROUP BY ALL),
b AS (SELECT CAST(s.id_student AS INTEGER) AS id_student, code_module,
             CAST(CAST(floor(date_submitted / 15) AS INTEGER) AS VARCHAR) AS code_presentation,
             count(*) AS right_rows, sum(CAST(score AS DECIMAL(18, 2))) AS score
      FROM ({v.SUBMISSIONS}) s JOIN cust c ON s.id_student = c.id_student GROUP BY ALL)
SELECT a.id_student, a.code_module, a.code_presentation, left_rows, COALESCE(right_rows, 0) AS right_rows,
       left_rows * GREATEST(COALESCE(right_rows, 0), 1) AS merged_rows,
       left_rows * GREATEST(COALESCE(right_rows, 0), 1) AS sum_sum_click, round(CAST(score * left_rows AS DOUBLE), 2) AS sum_score
FROM a LEFT JOIN b USING (id_student, code_module, code_presentation)""",
}
