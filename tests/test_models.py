"""Baseline classifiers on data with a known signal."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import models


@pytest.fixture(scope="module")
def classes(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        label = 2 if i % 2 else i % 3
        rows.append((i, label, rng.gauss(label * 3, 1), rng.gauss(0, 1), 4.0))
    return models.assemble(spark.createDataFrame(rows, "k int, y int, a double, b double, c double"), ["a", "b", "c"], ["k", "y"])


def test_models_beat_the_majority(classes):
    got = {r.model: r for r in models.holdout_scores(classes, "k", "y", ["majority", "logistic", "forest"]).collect()}
    assert got["logistic"].accuracy > got["majority"].accuracy + 0.1
    assert got["forest"].accuracy > got["majority"].accuracy + 0.1
    assert len({r.n_test for r in got.values()}) > 1  # each model gets its own draw


def test_cross_validation_covers_every_row_once(classes):
    got = models.cross_validated_scores(classes, "k", "y", ["majority", "logistic"]).collect()
    assert sorted((r.model, r.fold) for r in got) == sorted((m, f) for m in ("majority", "logistic") for f in range(5))
    assert sum(r.n_test for r in got if r.model == "majority") == 300


def test_fits_of_a_cross_validation_overlap(classes):
    """Each fit waits until a second one has begun; one after the other they would never meet."""
    meet = threading.Barrier(2, timeout=60)

    def made(label, n_train):
        if n_train:
            meet.wait()
        return models.logistic(label, n_train, 5)

    got = models.cross_validated_scores(classes, "k", "y", ["logistic"], 2, {"logistic": made}).collect()
    assert sorted(r.fold for r in got) == [0, 1]


def test_many_rows_are_dealt_to_several_tasks(classes, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    seen = []

    def made(label, n_train):
        pipeline = models.logistic(label, n_train, 5)
        fit = pipeline.fit
        pipeline.fit = lambda train: seen.append(train.select(F.spark_partition_id()).distinct().count()) or fit(train)
        return pipeline

    got = models.cross_validated_scores(classes, "k", "y", ["logistic"], 2, {"logistic": made}).collect()
    assert sum(r.n_test for r in got) == 300
    assert min(seen) > 1


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert sorted(tuple(r) for r in models.standardise(df, ["x", "y"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_most_frequent_breaks_ties_low(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 1), (4, 1), (5, 2)], "k int, y int")
    assert df.limit(1).withColumn("m", models.most_frequent(df, "y")).first().m == 1
