"""The flat daily log from CSV to snapshot, checks and baselines."""

import random

import pytest

from sessionloom.plans import flat_log as f
from sessionloom.sources.schemas import STUDENT_ATTRIBUTES

COUNTERS = ["quiz", "url"]


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    rng = random.Random(2)
    names = ["id_student", "code_module", "code_presentation", *STUDENT_ATTRIBUTES, "date", "dataplus", *COUNTERS, "score"]
    lines = [",".join(names)]
    for student in range(60):
        module, pres, result = student % 2, 1 + 2 * (student % 2), student % 4
        attributes = [str(rng.randrange(3)) for _ in STUDENT_ATTRIBUTES[:-1]] + [str(result)]
        for day in rng.sample(range(200, 300), 12):
            score = str(rng.randrange(100)) if student % 3 == 0 and day > 250 else ""
            row = [student, module, pres, *attributes, day, 7, result + 1, rng.randrange(4), score]
            lines.append(",".join(map(str, row)))
    path = tmp_path_factory.mktemp("flat") / "log.csv"
    path.write_text("\n".join(lines) + "\n")
    return f.load(spark, str(path), COUNTERS)


def test_snapshot_and_counts(flat):
    snap = f.snapshot(flat, COUNTERS)
    rows = snap.collect()
    assert len(rows) == 60 and all(r.quiz == 12 * (r.final_result + 1) for r in rows)
    assert "dataplus" not in snap.columns and "date" not in snap.columns
    cells = {(r.code_module, r.code_presentation): r.n for r in f.sessions_per_course(snap).collect()}
    assert len(cells) == 28 and cells[0.0, 1.0] == 30 and cells[1.0, 3.0] == 30 and sum(cells.values()) == 60
    assert f.interaction_summary(snap, COUNTERS).first()["count"] == 60


def test_score_coverage(flat):
    rows = f.score_coverage(flat).collect()
    assert sum(r.all_rows for r in rows) == 720 and sum(r.entities for r in rows) == 60
    assert all(r.first_scored_day > 250 and r.scored_rows < r.all_rows for r in rows)


def test_regularity_on_rows(flat):
    rows = f.with_regularity(flat).collect()
    assert len(rows) == 720
    assert all(r.gaps == 11 and r.gap_std is not None and r.week >= 1 for r in rows)


def test_baselines(flat):
    vectors = f.labelled_vectors(f.snapshot(flat, COUNTERS), COUNTERS)
    got = {r.model: r.accuracy for r in f.baseline_scores(vectors, ["majority", "logistic"]).collect()}
    assert got["logistic"] > got["majority"]
