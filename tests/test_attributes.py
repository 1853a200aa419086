"""Text codes, rolled-up sketches, correlations with gaps, binned pairs and model checks."""

import math

import numpy as np
import pytest
from rows import records
from pyspark.sql import functions as F

from sessionloom.operators import encode, features, histograms, models, profile, sketches


def test_encode_orders_bytewise_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "Z"), (4, "é"), (5, "b"), (6, "")], "k int, t string")
    got = encode.encode(df, ["t"])
    assert records(got) == [(1, "b", 2), (2, None, None), (3, "Z", 1), (4, "é", 3), (5, "b", 2), (6, "", 0)]
    with pytest.raises(ValueError):
        encode.encode(got, ["t"])


def test_codes_apply_to_other_rows_and_back(spark):
    df = spark.createDataFrame([("a", 3), ("b", 10), ("c", 3)], "t string, n int")
    codes = encode.dictionary(df, ["t", "n"])
    other = spark.createDataFrame([("c", 10), ("x", 4)], "t string, n int")
    coded = encode.encode(other, ["t", "n"], codes)
    assert records(coded) == [("c", 10, 2, 0), ("x", 4, None, None)]
    back = encode.decode(coded, "t_code", codes, "t", "text")
    assert records(back.select("t", "text")) == [("c", "c"), ("x", None)]


def test_a_million_values_without_a_driver_list(spark):
    df = spark.range(1_000_000).select(F.format_string("%07d", F.col("id")).alias("t"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert encode.encode(df, ["t"]).filter("t_code <> id or t_code is null").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_snapshot_keeps_text(spark):
    rows = [(1, 2, "x", 4.0), (1, 3, None, 4.0), (2, 1, None, 5.0), (None, 9, "y", 1.0)]
    df = spark.createDataFrame(rows, "k int, clicks int, region string, size double")
    got = features.session_snapshot(df, ["k"], ["clicks"], ["size"], ["region"])
    assert records(got) == [(1, 5, 4.0, "x"), (2, 1, 5.0, None)]


def test_sketches_roll_up(spark):
    df = spark.range(60_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 7919).alias("who"))
    days = sketches.daily_sketches(df, ["day"], "who")
    whole = sketches.estimated(sketches.roll_up(days, [])).first()["estimate"]
    assert abs(whole - 7919) <= 4 * sketches.relative_error() * 7919
    halves = sketches.roll_up(days, {"half": F.col("day") >= 5})
    assert halves.count() == 2 and halves.columns == ["half", "sketch"]
    ok = sketches.within_error(F.lit(8100), F.lit(7919))
    assert spark.range(1).select(ok).first()[0] and not spark.range(1).select(sketches.within_error(F.lit(9999), F.lit(7919))).first()[0]


def test_correlation_with_gaps_and_large_means(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(900, 6)) + np.array([0, 1e9, -1e6, 0, 5, 0])
    data[:, 5] = 0.1
    data[rng.random(data.shape) < 0.2] = np.nan
    names = [f"c{i}" for i in range(6)]
    rows = [tuple(None if i % 2 and math.isnan(x) else float(x) for x in r) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.row_name, r.col_name): r.r for r in profile.correlation_matrix(df, names).collect()}
    assert len(got) == 36
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            if 5 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                want = np.corrcoef(data[both, i], data[both, j])[0, 1]
                assert got[names[i], names[j]] == pytest.approx(want, abs=1e-6)


def test_correlation_plan_repeats_no_row(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    text = profile.correlation_matrix(df, ["a", "b"])._jdf.queryExecution().toString()
    scan = text.split("Physical Plan")[-1].split("MapInArrow")[-1]
    assert "Generate" not in scan and "MapInArrow" in text


@pytest.mark.parametrize("rows", [[], [(None,), (float("nan"),)]])
def test_profiles_of_empty_columns(spark, rows):
    df = spark.createDataFrame(rows, "x double")
    assert profile.correlation_matrix(df, ["x"]).collect() == [("x", "x", None)]
    assert histograms.density_curve(df, "x").collect() == []
    assert profile.describe(df, ["x"]).first()["count"] == 0


def test_sparsity_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "x double")
    r = profile.sparsity_profile(df, ["x"]).first()
    assert (r.zero, r.nonzero, r.nonzero_or_null, r.non_null) == (1, 1, 3, 2)


def test_density_of_a_continuous_column_sends_a_row_per_task(spark):
    df = spark.range(0, 5000, numPartitions=4).select(F.sin(F.col("id").cast("double")).alias("x"))
    curve = histograms.density_curve(df, "x")
    assert "Generate" not in curve._jdf.queryExecution().toString().split("Physical Plan")[-1].split("Exchange")[-1]
    values = np.sin(np.arange(5000.0))
    h = values.std(ddof=1) * 5000**-0.2
    for r in curve.filter("point in (0, 37, 99)").collect():
        want = np.exp(-0.5 * ((r.x - values) / h) ** 2).sum() / (5000 * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want, rel=1e-9)


def test_binned_pairs_and_outsiders(spark):
    df = spark.createDataFrame([(0.0, 1.0, "a"), (10.0, 3.0, "a"), (10.0, None, "b"), (5.0, 2.0, None)], "x double, y double, c string")
    got = records(histograms.pair_bins(df, ["x"], ["y"], "c", 2, 2))
    assert got == [("x", "y", "a", 0, 0, 1), ("x", "y", "a", 1, 1, 1)]
    loss = profile.contingency_loss(df, "x", [0.0, 10.0], "c", ["a"]).first()
    assert tuple(loss) == (4, 2, 1, 1)
    bars = profile.stacked_counts(df.na.fill({"c": "z"}), "c", "x", [0.0, 5.0], "rest")
    assert records(bars) == [("a", 1, 0, 1), ("b", 0, 0, 1), ("z", 0, 1, 0)]


def test_shared_bins_without_groups(spark):
    df = spark.createDataFrame([(float(i), i % 2 == 0) for i in range(10)] + [(None, True)], "x double, hit boolean")
    got = histograms.shared_bins(df, "x", {"hits": F.col("hit")}, 3).orderBy("bin").collect()
    assert [(r.n, r.hits) for r in got] == [(3, 2), (3, 1), (4, 2)]


def test_models_take_their_settings(spark):
    made = models.makers(max_iter=7, trees=3, max_depth=2, seed=1)
    fitted = made["forest"]("label", 10).getStages()[-1]
    assert (fitted.getNumTrees(), fitted.getMaxDepth()) == (3, 2)
    assert made["logistic"]("label", 10).getStages()[-1].getMaxIter() == 7
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 3).cast("double").alias("a"))
    r = models.against_majority(models.assemble(df, ["a"], ["k", "label"]), "k", "label", "forest", made=made).first()
    assert r.beats_majority and r.accuracy == 1.0 and 0.5 < r.majority_accuracy < 0.8
