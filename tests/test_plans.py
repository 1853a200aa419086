"""Shape of the physical plans: what reaches the scan, what never appears."""

import pytest

from sessionloom.plans import catalog

QUERIES = catalog.QUERIES
MODELS = {"logistic_holdout", "forest_holdout", "snapshot_holdout", "model_cv", "majority_cv"}


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_cross_join_and_no_python_rows(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    if name not in ("zip_csv_scan", "zip_members"):
        assert "InPandas" not in text


@pytest.mark.parametrize("name", ["session_daily_pivot", "session_snapshot", "score_coverage", "gap_cv"])
def test_only_needed_event_columns_are_read(spark, sf_dir, name):
    scans = [line for line in plan(QUERIES[name](spark, sf_dir)).splitlines() if "ReadSchema" in line]
    assert scans and all("props" not in s for s in scans)
    if name != "score_coverage":
        assert all("value" not in s for s in scans)


def test_daily_pivot_collapses_before_the_join(spark, sf_dir):
    text = plan(QUERIES["session_daily_pivot"](spark, sf_dir)).split("\n\n")[0]
    assert text.index("Join") < text.index("HashAggregate")  # the join sits above the aggregate


def test_threshold_filter_reaches_the_scan(spark, sf_dir):
    assert "LessThanOrEqual(o_totalprice" in plan(QUERIES["quantile_trim"](spark, sf_dir))


def test_first_per_key_limits_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["first_per_entity"](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_pivot_needs_one_shuffle(spark, sf_dir):
    from sessionloom.plans import stand_ins as v

    assert plan(v.student_days(spark, sf_dir)).split("\n\n")[0].count("Exchange") == 1
