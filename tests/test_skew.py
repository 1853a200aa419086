"""Hot keys and large groups, checked against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from rows import records
from pyspark.sql import functions as F

from sessionloom.operators import features, joins, quantiles, ranking


@pytest.fixture(scope="module")
def hot(spark):
    """2,000 rows, a third of them on key 7, half of the other keys unmatched."""
    rng = random.Random(3)
    data = [(i, 7 if i % 3 == 0 else rng.randrange(400), rng.randrange(30)) for i in range(2000)]
    return data, spark.createDataFrame(data, "row int, k int, day int").repartition(8)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_equals_plain_join(spark, hot, how):
    _, left = hot
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 400, 2)] + [(7, 70)], "k int, v int")
    salted = joins.salted_join(left, right, ["k"], how, parts=20)
    assert records(salted) == records(left.join(right, "k", how).select(*salted.columns))


def test_salted_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, x int")
    right = spark.createDataFrame([(1, 5)], "k int, v int")
    assert records(joins.salted_join(left, right, ["k"])) == [(None, 1, None), (None, 2, None), (1, 3, 5)]


@pytest.fixture
def shuffled_joins(spark):
    """Shuffle joins only, partitions left as planned."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, value in conf.items():
        spark.conf.set(k, value)
    yield
    for k, value in before.items():
        spark.conf.set(k, value)


def test_hot_rows_reach_several_tasks(spark, hot, shuffled_joins):
    _, left = hot
    right = spark.createDataFrame([(k, k) for k in range(400)], "k int, v int")
    where = F.spark_partition_id()
    plain = left.join(right, "k", "left").filter("k = 7").groupBy(where).count().collect()
    salted = joins.salted_join(left, right, ["k"], parts=60).filter("k = 7").groupBy(where).count().collect()
    assert len(plain) == 1
    assert len(salted) >= 6 and sum(r["count"] for r in salted) == plain[0]["count"]


def test_fan_out_totals_equal_the_merged_rows(spark, hot):
    _, left = hot
    right = spark.createDataFrame([(k % 9, float(k)) for k in range(60)], "k int, mark double")
    totals = joins.fan_out_totals(left, right, ["k"], ["day"], ["mark"])
    merged = left.join(right, "k", "left").groupBy("k").agg(
        F.count(F.lit(1)).alias("merged_rows"), F.sum("day").alias("sum_day"), F.sum("mark").alias("sum_mark")
    )
    assert records(totals.select(*merged.columns)) == records(merged)


def test_outer_variants_equal_a_full_outer_join(spark, hot):
    _, left = hot
    dim = spark.createDataFrame([(k, k + 1) for k in range(350, 450)], "k int, v int")
    got = joins.dimension_outer_merge(left, dim, ["k"])
    want = left.join(dim, "k", "full_outer")
    assert records(got) == records(want.select(*got.columns))

    daily = left.groupBy("k", "day").agg(F.count(F.lit(1)).alias("n"))
    subs = spark.createDataFrame([(i % 40, i % 35, i) for i in range(500)], "k int, sent int, a int")
    got = joins.activity_assessment_merge(daily, subs, ["k"], "day", "sent", ["n"])
    want = daily.join(subs.withColumnRenamed("sent", "day"), ["k", "day"], "full_outer").na.fill(0, subset=["n"])
    assert records(got) == records(want.select(*got.columns))


def test_join_invariants_equal_the_merge(spark, hot):
    _, left = hot
    right = spark.createDataFrame([(k, 1) for k in (7, 7, 8, 1000)], "k int, v int")
    r = joins.join_invariants(left, right, ["k"]).first()
    merged = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), "k", "full_outer")
    assert r.outer_rows == merged.count()
    assert r.left_unmatched == merged.filter("r is null").count()
    assert r.right_unmatched == merged.filter("l is null").count() == 2
    assert r.right_dup_keys == 1 and r.output_columns == 4


def test_gap_metrics_against_brute_force(hot):
    data, df = hot
    days = defaultdict(list)
    for _, k, d in data:
        days[k].append(d)
    for r in features.gap_metrics(df, ["k"], "day").collect():
        gaps = np.diff(sorted(days[r.k]))
        assert r.gaps == len(gaps)
        if len(gaps) > 1:
            assert r.gap_std == pytest.approx(np.std(gaps, ddof=1), abs=1e-12)
        else:
            assert r.gap_std is None
        if len(gaps) > 1 and gaps.mean() > 0:
            assert r.gap_cv == pytest.approx(np.std(gaps, ddof=1) / gaps.mean(), abs=1e-12)


SHAPES = {
    "uniform": lambda rng, n: rng.random(n),
    "heavy tail": lambda rng, n: np.exp(rng.normal(0, 6, n)),
    "few values": lambda rng, n: rng.integers(0, 4, n).astype(float),
    "one hot value": lambda rng, n: np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 1e6, n)),
    "constant": lambda rng, n: np.full(n, 2.5),
    "negative": lambda rng, n: -rng.random(n) * 1e-9,
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [1, 2, 900, 6000])
def test_exact_quantiles_equal_numpy(spark, shape, n):
    """accuracy=100 forces the bracketed path from 1,001 rows on."""
    values = SHAPES[shape](np.random.default_rng(n), n)
    df = spark.createDataFrame([(float(x),) for x in values], "x double").repartition(3)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = {r.prob: r["quantile"] for r in quantiles.exact_quantiles(df, ["x"], probs, accuracy=100).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


def test_exact_quantiles_by_group_and_column(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else "cold", float(rng.normal()), int(rng.integers(0, 50))) for i in range(5000)]
    rows += [("tiny", 1.0, 2), (None, 9.0, 9), ("hot", None, 3)]
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(4)
    got = {(r.g, r.feature, r.prob): r["quantile"] for r in
           quantiles.exact_quantiles(df, ["x", "y"], [0.1, 0.9], ["g"], accuracy=100).collect()}
    assert len(got) == 12
    for (g, feature, p), q in got.items():
        column = [r[1] if feature == "x" else r[2] for r in rows if r[0] == g]
        assert q == pytest.approx(np.quantile([c for c in column if c is not None], p), rel=1e-12)


def test_row_number_equals_a_window(spark, hot):
    from pyspark.sql import Window

    _, df = hot
    got = ranking.with_row_number(df, ["day", "row"], ["k"])
    w = Window.partitionBy("k")
    want = df.withColumn("row_number", F.row_number().over(w.orderBy("day", "row")).cast("bigint"))
    want = want.withColumn("group_rows", F.count(F.lit(1)).over(w))
    assert records(got) == records(want)


def test_row_number_over_everything(spark):
    got = ranking.with_row_number(spark.range(1000).repartition(7), ["id"]).collect()
    assert all(r.row_number == r.id + 1 and r.group_rows == 1000 for r in got)


def test_trim_within_group(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", float(i * 10)) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, x double")
    kept = quantiles.trim_within(df, "x", 0.5, ["g"])
    assert {(r.g, r.n) for r in kept.groupBy("g").agg(F.count("*").alias("n")).collect()} == {("a", 51), ("b", 51)}


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_lookup_join_both_ways(spark, hot, limit):
    _, df = hot
    first = df.groupBy("k").agg(F.min("day").alias("first"))
    want = records(df.join(first, "k", "left").select(*df.columns, "first"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = joins.group_lookup(df, first, ["k"])
        assert records(got.select(*df.columns, "first")) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookup_splits_equal_rows(spark, shuffled_joins):
    """A third of the rows is one row repeated; it lands in several tasks, also before an aggregate on its key."""
    rows = spark.range(0, 3000, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 400).cast("int").alias("k"), F.lit("same").alias("x")
    )
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    tagged = joins.group_lookup(rows, stats, ["k"])
    where = F.spark_partition_id()
    hot = tagged.filter("k = 7").groupBy(where).count().collect()
    assert len(hot) >= 3 and sum(r["count"] for r in hot) == 1006
    assert records(tagged.groupBy("k", "n").count()) == records(
        rows.join(stats, "k").groupBy("k", "n").count()
    )


def test_lookup_keeps_a_plan_without_hot_keys(spark, shuffled_joins):
    rows = spark.range(0, 3000, numPartitions=4).select((F.col("id") % 1500).alias("k"))
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    tagged = joins.group_lookup(rows, stats, ["k"])
    assert "__salt" not in tagged._jdf.queryExecution().toString() and tagged.count() == 3000


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("parts", [3, 40, 500])
def test_many_to_many_rows_equal_a_join(spark, hot, how, parts):
    _, left = hot
    right = spark.createDataFrame(
        [(7 if i % 3 == 0 else i % 500, i) for i in range(600)] + [(None, -1)], "k int, mark int"
    )
    left = left.unionByName(spark.createDataFrame([(-1, None, 0), (-2, None, 0)], left.schema))
    got = joins.many_to_many_rows(left, right, ["k"], how, parts)
    want = left.join(right, "k", how).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_many_to_many_grid_uses_several_tasks(spark, hot, shuffled_joins):
    """A third of both sides on one key: 667 x 200 rows, broadcast off."""
    _, left = hot
    right = spark.range(0, 600, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(1000 + F.col("id")).cast("int").alias("k"), F.col("id").alias("mark")
    )
    got = joins.many_to_many_rows(left, right, ["k"], "inner", 16).filter("k = 7")
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    n = left.filter("k = 7").count()
    assert sum(tasks) == n * 200 and len(tasks) >= 5 and max(tasks) < n * 200 / 2


def test_many_to_many_without_rows(spark, hot):
    _, left = hot
    none = spark.createDataFrame([], "k int, mark int")
    assert joins.many_to_many_rows(left, none, ["k"]).filter("mark is null").count() == 2000
    assert joins.many_to_many_rows(none, left, ["k"]).count() == 0


@pytest.mark.parametrize("text, size", [("10485760b", 10485760), ("10m", 10485760), ("-1", -1), ("1gb", 2**30)])
def test_broadcast_limit(spark, text, size):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
    try:
        assert joins.broadcast_limit(spark) == size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


EXTREMES = {
    "powers": lambda rng: np.repeat(1000.0 ** np.arange(-20, 60), 40),
    "both signs": lambda rng: np.concatenate([-np.exp(rng.normal(0, 30, 3000)), np.exp(rng.normal(0, 30, 3000)), np.zeros(500)]),
    "neighbours": lambda rng: 1.0 + rng.integers(0, 5000, 6000) * 2.0**-52,
    "outlier": lambda rng: np.append(rng.random(5000), 1e300),
    "hot and tail": lambda rng: np.where(rng.random(9000) < 0.34, 3.25, np.exp(rng.normal(0, 9, 9000))),
}


@pytest.mark.parametrize("shape", EXTREMES)
@pytest.mark.parametrize("bins", [8, 4096])
def test_refinement_of_extreme_columns(spark, shape, bins):
    values = EXTREMES[shape](np.random.default_rng(4))
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "x double").repartition(3)
    probs = [0.001, 0.2, 0.5, 0.9, 0.9999]
    got = {r.prob: r["quantile"] for r in quantiles.exact_quantiles(df, ["x"], probs, accuracy=bins).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_refinement_takes_few_scans(spark, monkeypatch):
    scans = []
    plain = quantiles._next_scan
    monkeypatch.setattr(quantiles, "_next_scan", lambda *a: scans.append(1) or plain(*a))
    df = spark.range(200_000).select((F.rand(3) * 1e6).alias("x"))
    quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], accuracy=512).collect()
    assert len(scans) <= 3


def test_trim_of_nan(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("nan"), None)], "x double")
    assert records(quantiles.trim(df, "x", 0.5, "lower")) == [(2.0,), (3.0,)]
    assert records(quantiles.trim(df, "x", 0.5)) == [(1.0,), (2.0,)]
    nothing = df.filter("x is null")
    assert quantiles.trim(nothing, "x", 0.5).count() == 0 and quantiles.band(nothing, "x", 0.1, 0.9).count() == 0


def test_quantiles_beside_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", x) for x in (1.0, inf, -inf, 2.0, 1.0)], "g string, x double")
    whole = quantiles.exact_quantiles(df, ["x"], [0.0, 0.25, 0.75, 1.0])
    grouped = quantiles.exact_quantiles(df, ["x"], [0.0, 0.25, 0.75, 1.0], ["g"])
    for got in (whole, grouped):
        assert [r["quantile"] for r in got.orderBy("prob").collect()] == [-inf, 1.0, 2.0, inf]
