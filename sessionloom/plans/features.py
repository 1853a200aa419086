"""Queries: session snapshot, week index, regularity, baselines' features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions.columns import code_label
from sessionloom.operators import features, profile, shape
from sessionloom.plans import stand_ins as v
from sessionloom.sources.schemas import RESULT_LABELS

KEYS = ["id_student", "code_presentation"]


def session_snapshot(spark, sf):
    return v.sessions(spark, sf).withColumns({a: F.round(a, 6) for a in v.ATTRIBUTES})


def total_interactions(spark, sf):
    totals = features.with_total(v.stored_sessions(spark, sf), v.ACTIVITY)
    return profile.describe(totals, ["total_interactions"])


def week_index(spark, sf):
    log = v.event_days(spark, sf).select("event_id", "code_presentation", "date")
    return features.with_week(log, ["code_presentation"], "date")


def day_rebase(spark, sf):
    log = v.event_days(spark, sf).select("event_id", "code_presentation", "date")
    return features.with_rebased_day(log, ["code_presentation"], "date")


def _with_gap(spark, sf, metric):
    log = v.event_days(spark, sf).select("event_id", *KEYS, "date")
    gaps = features.gap_metrics(log, KEYS, "date").select(*KEYS, F.round(metric, 6).alias(metric))
    return features.with_entity_metric(log, gaps, KEYS)


def gap_cv(spark, sf):
    return _with_gap(spark, sf, "gap_cv")


def gap_std(spark, sf):
    return _with_gap(spark, sf, "gap_std")


def _weekly(log):
    weekly = features.weekly_consistency(log, KEYS, "date", "week")
    names = ("active_days_per_week_mean", "active_days_per_week_sd")
    return weekly.select(*KEYS, *[F.round(c, 6).alias(c) for c in names])


def weekly_consistency(spark, sf):
    log = features.with_week(
        v.event_days(spark, sf).select("event_id", *KEYS, "date"), ["code_presentation"], "date"
    )
    return features.with_entity_metric(log, _weekly(log), KEYS)


def regularity_correlation(spark, sf):
    log = features.with_week(
        v.event_days(spark, sf).select(*KEYS, "date"), ["code_presentation"], "date"
    )
    metrics = features.regularity_metrics(log, KEYS, "date", "week")
    cols = ["region", "gap_cv", "gap_std", "active_days_per_week_sd", "final_result"]
    labelled = metrics.join(v.students(spark, sf).select("id_student", "region", "final_result"), "id_student")
    return profile.correlation_matrix(labelled, cols)


def label_decode(spark, sf):
    return v.students(spark, sf).select(
        "id_student", "final_result", code_label("final_result", RESULT_LABELS).alias("result_label")
    )


def cast_map(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"
    )
    narrow = shape.cast_columns(
        lines, {"l_orderkey": "int", "l_linenumber": "smallint", "l_quantity": "int"}
    )
    sliced = shape.column_slice(narrow, 0, -1)
    return sliced.withColumn(
        "discount_share", F.round(F.try_divide(F.col("l_discount") * 100, F.col("l_quantity")), 6)
    )


LISTED = [a for a in v.ACTIVITY if a != "signup"]


def pivot_other(spark, sf):
    """The daily pivot with one event type left off the list and gathered in a column of its own."""
    return shape.pivot_sum(
        v.event_days(spark, sf), ["id_student", "date"], "activity_type", "sum_click", LISTED, "other"
    )


def pivot_loss(spark, sf):
    return shape.pivot_loss(v.event_days(spark, sf), ["id_student", "date"], "activity_type", "sum_click", LISTED)


DESCRIBED = dict.fromkeys(("mean", "std", "min", "q25", "q50", "q75", "max"), 6)

QUERIES = {
    f.__name__: f
    for f in (
        v.display(total_interactions, DESCRIBED, even=True),
        v.display(regularity_correlation, {"r": 6}),
        session_snapshot, week_index, day_rebase, gap_cv, gap_std, weekly_consistency, label_decode, cast_map,
        pivot_other, pivot_loss,
    )
}

_STARTS = f"""
SELECT *, min(date) OVER (PARTITION BY code_presentation) AS first_day FROM ({v.EVENT_DAYS})"""
_WEEKS = f"""
SELECT event_id, id_student, code_presentation, date,
       CAST(floor((date - first_day) / 7) + 1 AS BIGINT) AS week FROM ({_STARTS})"""
_GAPS = f"""
SELECT id_student, code_presentation, count(gap) AS gaps, avg(gap) AS gap_mean, stddev_samp(gap) AS gap_std,
       stddev_samp(gap) / nullif(avg(gap), 0) AS gap_cv
FROM (SELECT *, date - lag(date) OVER (PARTITION BY id_student, code_presentation ORDER BY date) AS gap
      FROM ({v.EVENT_DAYS}))
GROUP BY id_student, code_presentation"""
_WEEKLY = f"""
SELECT id_student, code_presentation, avg(days) AS active_days_per_week_mean,
       stddev_samp(days) AS active_days_per_week_sd
FROM (SELECT id_student, code_presentation, week, count(DISTINCT date) AS days FROM ({_WEEKS}) GROUP BY ALL)
GROUP BY id_student, code_presentation"""


def correlation_sql(source: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            both = f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(
                f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(covar_pop({a}, {b}) / "
                f"nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM src {both}"
            )
    return f"WITH src AS MATERIALIZED ({source}) " + " UNION ALL ".join(parts)


def describe_sql(source: str, cols: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count({c}) AS count, round_even(avg({c}), 6) AS mean, "
        f"round_even(stddev_samp({c}), 6) AS std, round_even(min(CAST({c} AS DOUBLE)), 6) AS min, "
        + "".join(
            f"round_even(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS {n}, "
            for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        )
        + f"round_even(max(CAST({c} AS DOUBLE)), 6) AS max FROM src"
        for c in cols
    ]
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


_TOTAL = " + ".join(v.ACTIVITY)

_LISTED = ", ".join(f"'{a}'" for a in LISTED)

ORACLE = {
    "pivot_other": f"""
SELECT id_student, date,
       {", ".join(f"CAST(sum(CASE WHEN activity_type = '{a}' THEN sum_click ELSE 0 END) AS BIGINT) AS {a}" for a in LISTED)},
       CAST(sum(CASE WHEN activity_type IN ({_LISTED}) THEN 0 ELSE sum_click END) AS BIGINT) AS other
FROM ({v.EVENT_DAYS}) GROUP BY id_student, date""",
    "pivot_loss": f"""
SELECT CAST(sum(sum_click) AS BIGINT) AS total,
       CAST(sum(CASE WHEN activity_type IN ({_LISTED}) THEN sum_click ELSE 0 END) AS BIGINT) AS listed,
       CAST(sum(CASE WHEN activity_type NOT IN ({_LISTED}) THEN sum_click ELSE 0 END) AS BIGINT) AS unlisted,
       CAST(sum(CASE WHEN activity_type IS NULL THEN sum_click ELSE 0 END) AS BIGINT) AS no_level,
       CAST(sum(CASE WHEN id_student IS NULL OR date IS NULL THEN sum_click ELSE 0 END) AS BIGINT) AS no_key
FROM ({v.EVENT_DAYS})""",
    "session_snapshot": f"SELECT * REPLACE ({', '.join(f'round({a}, 6) AS {a}' for a in v.ATTRIBUTES)}) FROM ({v.SESSIONS})",
    "total_interactions": describe_sql(
        f"SELECT {_TOTAL} AS total_interactions FROM ({v.SESSIONS})", ["total_interactions"]
    ),
    "week_index": f"SELECT event_id, code_presentation, date, week FROM ({_WEEKS})",
    "day_rebase": f"SELECT event_id, code_presentation, date, date - first_day AS day_rebased FROM ({_STARTS})",
    "gap_cv": f"""
SELECT e.event_id, e.id_student, e.code_presentation, e.date, round(g.gap_cv, 6) AS gap_cv
FROM ({v.EVENT_DAYS}) e LEFT JOIN ({_GAPS}) g USING (id_student, code_presentation)""",
    "gap_std": f"""
SELECT e.event_id, e.id_student, e.code_presentation, e.date, round(g.gap_std, 6) AS gap_std
FROM ({v.EVENT_DAYS}) e LEFT JOIN ({_GAPS}) g USING (id_student, code_presentation)""",
    "weekly_consistency": f"""
SELECT e.event_id, e.id_student, e.code_presentation, e.date, e.week,
       round(active_days_per_week_mean, 6) AS active_days_per_week_mean,
       round(active_days_per_week_sd, 6) AS active_days_per_week_sd
FROM ({_WEEKS}) e LEFT JOIN ({_WEEKLY}) w USING (id_student, code_presentation)""",
    "regularity_correlation": correlation_sql(
        f"""SELECT s.region, s.final_result, g.gap_cv, g.gap_std, w.active_days_per_week_sd
FROM ({_GAPS}) g JOIN ({_WEEKLY}) w USING (id_student, code_presentation) JOIN ({v.STUDENTS}) s USING (id_student)""",
        ["region", "gap_cv", "gap_std", "active_days_per_week_sd", "final_result"],
    ),
    "label_decode": f"""
SELECT id_student, final_result,
       CASE final_result {' '.join(f"WHEN {k} THEN '{t}'" for k, t in RESULT_LABELS.items())} END AS result_label
FROM ({v.STUDENTS})""",
    "cast_map": """
SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber,
       CAST(l_quantity AS INTEGER) AS l_quantity, l_extendedprice, l_discount,
       round(l_discount * 100 / nullif(l_quantity, 0), 6) AS discount_share FROM lineitem""",
}
