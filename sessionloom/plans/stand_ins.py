"""The course-log tables as views over the star-schema test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.columns import days_since
from sessionloom.operators.features import session_snapshot
from sessionloom.operators.joins import left_merge
from sessionloom.operators.shape import pivot_sum
from sessionloom.sources.scratch import materialise

ORIGIN = "2024-01-01"
ACTIVITY = ["click", "error", "purchase", "signup", "view"]
MODULES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRESENTATIONS = [0, 1, 2, 3]
SESSION = ["id_student", "code_module", "code_presentation"]
ATTRIBUTES = ["balance", "region", "final_result"]


def display(query, digits: dict[str, int], even: bool = False):
    """The query with columns rounded for comparison; operators themselves do not round."""

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        half = F.bround if even else F.round
        return query(spark, sf_dir).withColumns({c: half(c, n) for c, n in digits.items()})

    shown.__name__ = query.__name__
    return shown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log with integer days; ``score`` is set on purchases only."""
    day = days_since("ts", ORIGIN)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("id_student"),
        F.floor(day / 15).cast("int").alias("code_presentation"),
        day.alias("date"),
        F.col("event_type").alias("activity_type"),
        F.lit(1).alias("sum_click"),
        "value",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("score"),
    )


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: module and numeric-coded attributes."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id_student"),
        F.col("c_mktsegment").alias("code_module"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("region"),
        F.pmod("c_nationkey", F.lit(4)).alias("final_result"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return left_merge(event_days(spark, sf_dir), students(spark, sf_dir).select("id_student", "code_module"))


def daily(spark: SparkSession, sf_dir: str, attributes: bool = False) -> DataFrame:
    """One row per student, session and day. The log is collapsed before the student join."""
    cols = ["id_student", "code_module", *(ATTRIBUTES if attributes else [])]
    pivot = pivot_sum(
        event_days(spark, sf_dir),
        ["id_student", "code_presentation", "date"],
        "activity_type",
        "sum_click",
        ACTIVITY,
    )
    return left_merge(pivot, students(spark, sf_dir).select(*cols))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_snapshot(daily(spark, sf_dir, attributes=True), SESSION, ACTIVITY, ATTRIBUTES)


def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot written once, for operators that pass over it more than once."""
    return materialise(sessions(spark, sf_dir), "sessions")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assessment submissions, on the day of the month they were placed."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id_student"),
        (F.dayofmonth("o_orderdate") - 1).alias("date_submitted"),
        F.col("o_orderkey").alias("id_assessment"),
        F.col("o_totalprice").alias("score"),
    )


def student_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity per student and day, without the session keys the orders lack."""
    return pivot_sum(
        event_days(spark, sf_dir), ["id_student", "date"], "activity_type", "sum_click", ACTIVITY
    )


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with missing discounts, to exercise the null rules."""
    return table(spark, sf_dir, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))


# SQL twins of the views above.
EVENT_DAYS = """
SELECT event_id, user_id AS id_student,
       CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / 15) AS INTEGER) AS code_presentation,
       CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS date,
       event_type AS activity_type, 1 AS sum_click, value,
       CASE WHEN event_type = 'purchase' THEN value END AS score
FROM events"""
STUDENTS = """
SELECT c_custkey AS id_student, c_mktsegment AS code_module, c_acctbal AS balance,
       c_nationkey AS region, CAST(c_nationkey % 4 AS INTEGER) AS final_result
FROM customer"""
COUNTERS = ", ".join(
    f"CAST(SUM(CASE WHEN activity_type = '{a}' THEN sum_click ELSE 0 END) AS BIGINT) AS {a}" for a in ACTIVITY
)
DAILY = f"""
SELECT d.*, s.code_module, s.balance, s.region, s.final_result
FROM (SELECT id_student, code_presentation, date, {COUNTERS} FROM ({EVENT_DAYS}) GROUP BY ALL) d
LEFT JOIN ({STUDENTS}) s USING (id_student)"""
SESSIONS = f"""
SELECT id_student, code_module, code_presentation,
       {", ".join(f"CAST(SUM({a}) AS BIGINT) AS {a}" for a in ACTIVITY)},
       {", ".join(f"AVG({a}) AS {a}" for a in ATTRIBUTES)}
FROM ({DAILY}) WHERE code_module IS NOT NULL GROUP BY id_student, code_module, code_presentation"""
SUBMISSIONS = """
SELECT o_custkey AS id_student, CAST(day(o_orderdate) - 1 AS INTEGER) AS date_submitted,
       o_orderkey AS id_assessment, o_totalprice AS score
FROM orders"""
STUDENT_DAYS = f"SELECT id_student, date, {COUNTERS} FROM ({EVENT_DAYS}) GROUP BY ALL"
CLICKS = f"SELECT e.*, s.code_module FROM ({EVENT_DAYS}) e LEFT JOIN ({STUDENTS}) s USING (id_student)"
GAPPY_LINES = "SELECT * REPLACE (nullif(l_discount, 0) AS l_discount) FROM lineitem"
