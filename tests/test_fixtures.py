"""Small cases with results worked out by hand."""

import math

import numpy as np
import pytest
from rows import records
from pyspark.sql import functions as F

from sessionloom.operators import features, histograms, joins, profile, quality, quantiles, ranking, shape

DAYS = [(1, 21), (1, 0), (1, 7), (1, 7), (2, 5), (3, 4), (3, 4), (4, 0), (4, 7), (4, 14)]


def test_gap_metrics(spark):
    df = spark.createDataFrame(DAYS, "id int, day int")
    got = {r.id: r for r in features.gap_metrics(df, ["id"], "day").collect()}
    assert (got[1].gaps, got[1].gap_std, got[1].gap_cv) == (3, 7.0, 1.0)
    assert (got[2].gaps, got[2].gap_std, got[2].gap_cv) == (0, None, None)
    assert (got[3].gaps, got[3].gap_std, got[3].gap_cv) == (1, None, None)
    assert (got[4].gaps, got[4].gap_std, got[4].gap_cv) == (2, 0.0, 0.0)


def test_weekly_consistency_skips_idle_weeks(spark):
    df = spark.createDataFrame([(i, d, d // 7 + 1) for i, d in DAYS], "id int, day int, week int")
    got = {r.id: r.active_days_per_week_sd for r in features.weekly_consistency(df, ["id"], "day", "week").collect()}
    assert got == {1: 0.0, 2: None, 3: None, 4: 0.0}


def test_regularity_metrics_equals_its_parts(spark):
    df = spark.createDataFrame([(i, d, d // 7 + 1) for i, d in DAYS], "id int, day int, week int")
    together = features.regularity_metrics(df, ["id"], "day", "week")
    apart = features.gap_metrics(df, ["id"], "day").join(
        features.weekly_consistency(df, ["id"], "day", "week"), "id"
    )
    assert records(together) == records(apart.select(*together.columns))


def test_gap_metrics_drops_null_keys_and_days(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (None, 3), (1, 4)], "id int, day int")
    assert [(r.id, r.gaps) for r in features.gap_metrics(df, ["id"], "day").collect()] == [(1, 1)]


def test_week_index(spark):
    df = spark.createDataFrame([(1, d) for d in (232, 238, 239, 260)], "pres int, day int")
    weeks = features.with_week(df, ["pres"], "day").orderBy("day").collect()
    assert [r.week for r in weeks] == [1, 1, 2, 5]


def test_fixed_edge_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 6, 7, 8)], "x double")
    got = histograms.histogram_edges(df, "x", [float(e) for e in range(8)]).orderBy("bin").collect()
    assert [r.n for r in got] == [1, 1, 0, 0, 0, 0, 2]


def test_equal_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 1, 2, 10)], "x int")
    got = histograms.histograms(df, ["x"], 10).orderBy("bin").collect()
    assert [r.n for r in got] == [1, 2, 1, 0, 0, 0, 0, 0, 0, 1]


def test_equal_bins_constant_column(spark):
    df = spark.createDataFrame([(3,), (3,)], "x int")
    got = histograms.histograms(df, ["x"], 4).orderBy("bin").collect()
    assert [r.n for r in got] == [0, 0, 2, 0]
    assert (got[0].bin_lo, got[-1].bin_hi) == (2.5, 3.5)


@pytest.mark.parametrize("bins", [1, 7, 10, 30])
def test_histograms_equal_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    columns = {"a": rng.normal(size=500), "b": rng.exponential(size=500) * 1e6, "c": rng.integers(0, 5, 500) * 1.0}
    df = spark.createDataFrame([tuple(map(float, row)) for row in zip(*columns.values())], list(columns))
    rows = histograms.histograms(df, list(columns), bins).collect()
    for name, values in columns.items():
        counts, edges = np.histogram(values, bins)
        ours = {r.bin: r for r in rows if r.feature == name}
        assert [ours[i].n for i in range(bins)] == counts.tolist()
        assert all(ours[i].bin_lo == pytest.approx(edges[i], abs=1e-6) for i in range(bins))


def test_describe(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 1, 2, 10)], "x int")
    r = profile.describe(df, ["x"]).first()
    assert r["count"] == 5 and (r["mean"], r["std"]) == pytest.approx((2.8, 4.08656334834051))
    assert (r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == (0.0, 1.0, 1.0, 2.0, 10.0)


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "x int")
    assert quantiles.exact_quantiles(df, ["x"], [0.98]).first()["quantile"] == 9.58


def test_correlation_is_pairwise_and_survives_constants(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, None, 5), (3, 6, 5), (4, 9, 5)], "a int, b int, c int")
    got = {(r.row_name, r.col_name): r.r for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(0.9941916256019201)
    assert got["a", "c"] is None and got["c", "c"] is None and got["a", "a"] == pytest.approx(1.0)


def test_correlation_of_many_columns(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 25))
    names = [f"c{i}" for i in range(25)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in data], names)
    got = {(r.row_name, r.col_name): r.r for r in profile.correlation_matrix(df, names).collect()}
    want = np.corrcoef(data.T)
    assert len(got) == 625
    assert all(abs(got[names[i], names[j]] - want[i, j]) < 1e-6 for i in range(25) for j in range(25))


def test_correlation_without_complete_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, 3)], "a int, b int")
    got = {(r.row_name, r.col_name): r.r for r in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): None, ("b", "a"): None, ("b", "b"): None}


def test_approximate_quantiles_return_members(spark):
    df = spark.range(1, 1001).toDF("x")
    got = {r.prob: r["quantile"] for r in quantiles.approximate_quantiles(df, ["x"], [0.25, 0.5]).collect()}
    assert got == {0.25: 250.0, 0.5: 500.0}
    assert profile.describe(df, ["x"], exact=False).first()["q50"] == 500.0


def test_null_keys_and_all_null_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), (None, 4)], "k string, x int")
    assert records(features.session_snapshot(df, ["k"], ["x"], [])) == [("a", 1), ("b", 0)]


def test_null_safe_merge(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), (None, 4)], "k string, x int")
    other = df.withColumnRenamed("x", "y")
    inner = lambda how_null: joins.left_merge(df, other.withColumn("hit", F.lit(1)), ["k"], how_null).filter("hit = 1")
    assert (inner(True).count(), inner(False).count()) == (6, 5)
    outer = joins.outer_merge(
        spark.createDataFrame([(None, 1)], "k string, x int"),
        spark.createDataFrame([(None, 2), ("z", 3)], "k string, y int"),
        null_safe=True,
    )
    assert records(outer) == [(None, 1, 2), ("z", None, 3)]


def test_sparsity_counts_nulls_both_ways(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (None,)], "x int")
    r = profile.sparsity_profile(df, ["x"]).first()
    assert (r.zero, r.nonzero_or_null, r.non_null, r.nonzero) == (2, 2, 3, 1)
    assert (r.pct_zero, r.pct_nonzero, r.zero_share_of_rows) == (66.67, 66.67, 0.5)


def test_sparsity_of_an_empty_column(spark):
    r = profile.sparsity_profile(spark.createDataFrame([(None,)], "x int"), ["x"]).first()
    assert (r.zero, r.non_null, r.pct_zero) == (0, 0, None)


def test_missing_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert records(profile.missing_counts(df)) == [("a", 0), ("b", 1)]
    assert records(shape.schema_profile(df)) == [("a", 0, "int", 2, 2), ("b", 1, "string", 2, 1)]


def test_chunks_take_the_remainder_first(spark):
    df = spark.range(20).withColumnRenamed("id", "x")
    got = ranking.with_chunk(df, ["x"], 13).orderBy("x").collect()
    sizes = [sum(1 for r in got if r.chunk == c) for c in range(13)]
    assert sizes == [2] * 7 + [1] * 6
    assert [r.chunk for r in got] == sorted(r.chunk for r in got)


def test_more_chunks_than_rows(spark):
    got = ranking.with_chunk(spark.range(3), ["id"], 5).orderBy("id").collect()
    assert [r.chunk for r in got] == [0, 1, 2]


@pytest.fixture
def pivot_case(spark):
    clicks = spark.createDataFrame(
        [(1, 0, "quiz", 2), (1, 0, "quiz", 3), (1, 0, "url", 1), (1, 5, "url", 4), (1, 6, None, 9)],
        "id int, day int, activity string, n int",
    )
    subs = spark.createDataFrame(
        [(1, 0, 10, 80.0), (1, 0, 11, 60.0), (1, 9, 12, 50.0)],
        "id int, submitted int, assessment int, score double",
    )
    levels = ["quiz", "url", "page"]
    daily = shape.pivot_sum(clicks, ["id", "day"], "activity", "n", levels)
    return daily, joins.activity_assessment_merge(daily, subs, ["id"], "day", "submitted", levels), levels


def test_pivot_merge_and_checks(pivot_case):
    daily, merged, levels = pivot_case
    assert records(daily) == [(1, 0, 5, 1, 0), (1, 5, 0, 4, 0)]
    assert set(records(merged)) == {
        (1, 0, 5, 1, 0, 10, 80.0),
        (1, 0, 5, 1, 0, 11, 60.0),
        (1, 5, 0, 4, 0, None, None),
        (1, 9, 0, 0, 0, 12, 50.0),
    }
    assert records(quality.multi_assessment_days(merged, ["id", "day"], "assessment")) == [(1, 0, 2)]
    quiet = quality.inactive_submissions(merged, levels, "score")
    assert [(r.id, r.day) for r in quiet.collect()] == [(1, 9)]


def test_density_integrates_to_about_one(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 3, 3, 4, 4, 5)], "x double")
    curve = histograms.density_curve(df, "x").orderBy("point").collect()
    assert len(curve) == 100 and curve[0].x == 1.0 and curve[-1].x == 5.0
    values = [1, 2, 2, 3, 3, 3, 4, 4, 5]
    mean = sum(values) / 9
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / 8) * 9 ** (-0.2)
    at = curve[50].x
    want = sum(math.exp(-0.5 * ((at - v) / h) ** 2) for v in values) / (9 * h * math.sqrt(2 * math.pi))
    assert abs(curve[50].density - want) < 1e-6


def test_score_order(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, 5.0), ("b", 3, 5.0), ("b", 4, None), ("c", 1, None), ("d", 1, 2.0)],
        "id string, day int, score double",
    )
    got = {r.id: r.unscored_precede_scored for r in quality.score_order_check(df, ["id"], "day", "score").collect()}
    assert got == {"a": True, "b": False, "d": True}


def test_contingency_keeps_zero_cells(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (9, 9)], "a int, b int")
    assert records(profile.contingency(df, "a", [0, 1], "b", [0, 1])) == [(0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 1, 0)]


def test_overflow_raises_instead_of_wrapping(spark):
    df = spark.createDataFrame([(40000,)], "x int")
    with pytest.raises(Exception, match="OVERFLOW"):
        shape.cast_columns(df, {"x": "smallint"}).collect()
