"""The flat daily log: one wide row per student, session and day, all columns numeric-coded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import features, models, profile, quality
from sessionloom.sources.files import read_csv
from sessionloom.sources.schemas import ACTIVITIES, STUDENT_ATTRIBUTES, flat_schema

SESSION = ["id_student", "code_module", "code_presentation"]
COURSE = ["code_module", "code_presentation"]
# Code domains of the log, and the counter its snapshot leaves out.
MODULE_CODES = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
PRESENTATION_CODES = [0.0, 1.0, 2.0, 3.0]
LEFT_OUT = "dataplus"

COUNTERS = [a for a in ACTIVITIES if a != LEFT_OUT]


def load(spark: SparkSession, path: str, counters: Sequence[str] = tuple(COUNTERS)) -> DataFrame:
    return read_csv(spark, path, flat_schema(list(counters)))


def snapshot(flat: DataFrame, counters: Sequence[str] = tuple(COUNTERS)) -> DataFrame:
    """One row per session: counters summed, attributes averaged, day and score left out."""
    return features.session_snapshot(flat, SESSION, counters, STUDENT_ATTRIBUTES)


def sessions_per_course(snap: DataFrame) -> DataFrame:
    """Dense module x presentation table of session counts."""
    return profile.contingency(snap, "code_module", MODULE_CODES, "code_presentation", PRESENTATION_CODES)


def interaction_summary(snap: DataFrame, counters: Sequence[str] = tuple(COUNTERS)) -> DataFrame:
    return profile.describe(features.with_total(snap, counters), ["total_interactions"])


def score_coverage(flat: DataFrame) -> DataFrame:
    return quality.score_coverage(flat, COURSE, "id_student", "date", "score")


def with_regularity(flat: DataFrame, keys: Sequence[str] = tuple(SESSION)) -> DataFrame:
    """The rows with their week and their entity's regularity metrics."""
    weekly = features.with_week(flat, ["code_presentation"], "date")
    metrics = features.regularity_metrics(weekly, keys, "date", "week")
    return features.with_entity_metric(weekly, metrics, keys)


def labelled_vectors(snap: DataFrame, counters: Sequence[str] = tuple(COUNTERS)) -> DataFrame:
    """Session key, result code and feature vector; sessions with a gap in a feature are left out."""
    inputs = [*counters, *[a for a in STUDENT_ATTRIBUTES if a != "final_result"]]
    keyed = snap.withColumns(
        {"session_key": F.concat_ws("|", *SESSION), "label": F.col("final_result").cast("int")}
    )
    complete = keyed.na.drop(subset=[*inputs, "label"])
    return models.assemble(complete, inputs, ["session_key", "label"])


def baseline_scores(vectors: DataFrame, names: Sequence[str] = ("majority", "logistic", "forest")) -> DataFrame:
    return models.holdout_scores(vectors, "session_key", "label", list(names))


def baseline_cv(vectors: DataFrame, names: Sequence[str] = ("majority", "logistic", "forest")) -> DataFrame:
    return models.cross_validated_scores(vectors, "session_key", "label", list(names))
