"""The quality classifier: statistics by hand, densities by brute force, accuracy on held-out rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge_cases import TEXTS, edge_documents, no_documents
from pyspark.sql import functions as F

from sessionloom.llm import quality
from sessionloom.llm.tables import table

SF = "/root/testdata/sf0.01"


def naive_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = len(words), sum(b not in b" \t\n\x0b\x0c\r" for b in raw)
    share = lambda test: sum(map(test, raw)) / (size + 40)
    marks = b".,;:!?'\"()-"
    lengths = [math.log1p(len(w)) for w in words]
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean**2, 0))
    shown = Counter(b for b in raw if b >= 33)
    total = max(sum(shown.values()), 1)
    pairs = list(zip(words, words[1:]))
    most = max(Counter(words).values(), default=0)
    small, capital, digit = (lambda b: 97 <= b <= 122), (lambda b: 65 <= b <= 90), (lambda b: 48 <= b <= 57)
    white = b" \t\n\x0b\x0c\r"
    symbol = lambda b: b < 128 and not (small(b) or capital(b) or digit(b) or b in marks or b in white)
    return [
        math.log1p(n), mean, spread, share(small), math.sqrt(share(capital)), math.sqrt(share(digit)),
        math.sqrt(share(lambda b: b in marks)), math.sqrt(share(symbol)), math.sqrt(share(lambda b: b >= 128)),
        math.sqrt(raw.count(b"\n") / (n + 10)), math.sqrt(sum(a == b for a, b in pairs) / (n + 10)),
        math.sqrt(max(most - 1, 0) / (n + 10)), math.log((len(set(words)) + 5) / (n + 5)) / math.log(n + 10),
        math.log((len(set(pairs)) + 10) / (max(n - 1, 0) + 10)),
        -sum(c / total * math.log(c / total) for c in shown.values()) * size / (size + 10),
    ]


def test_statistics():
    texts = [t[1] for t in TEXTS] + ["a a a b", "Und und *** ### !!", "x\n\ny\nz 12 é é"]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, [naive_statistics(t) for t in texts], atol=1e-6)
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def test_densities_equal_the_formula():
    rng = np.random.default_rng(1)
    rows = {0: rng.normal(1, 2, (60, 3)) @ rng.normal(0, 1, (3, 3)), 1: rng.normal(0, 1, (200, 3))}
    sums = [quality.Sums(len(rows[c]), rows[c].sum(0), rows[c].T @ rows[c]) for c in (0, 1)]
    model = quality.discriminant(*sums, pooled=0.25, sphere=0.1)
    scatter = [np.cov(rows[c].T, bias=False) * (len(rows[c]) - 1) for c in (0, 1)]
    both = (scatter[0] + scatter[1]) / 258
    scale = np.sqrt(np.diag(both))
    x = rng.normal(0, 3, (20, 3))
    density = []
    for c in (0, 1):
        drawn = (0.75 * np.cov(rows[c].T) + 0.25 * both) / np.outer(scale, scale)
        sigma = 0.9 * drawn + 0.1 * np.trace(drawn) / 3 * np.eye(3)
        away = (x - rows[c].mean(0)) / scale
        maha = np.array([a @ np.linalg.inv(sigma) @ a for a in away])
        density.append(-0.5 * (maha + np.log(np.linalg.det(sigma))))
    assert np.allclose(model.difference(x), density[1] - density[0])


def test_sums_over_tasks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, (300, len(quality.FEATURES)))
    rows = [(i % 2, i % 5, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "quality int, fold int, x array<double>").repartition(7)
    got = quality._class_sums(df)
    for (c, f), s in got.items():
        mine = np.array([r[2] for r in rows if r[:2] == (c, f)])
        assert s.n == len(mine) and np.allclose(s.x, mine.sum(0)) and np.allclose(s.xx, mine.T @ mine)


def test_held_out_rows_are_told_apart(spark):
    got = quality.op12_text_quality(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert got.count() == docs.count()
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    poor = [r.predicted for r in rows if r.quality == 0]
    assert len(good) > 20 and len(poor) > 3
    assert sum(good) / len(good) >= 0.95 and sum(poor) / len(poor) <= 0.1
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.judged(docs, t).orderBy("doc_id").collect() for t in (labels, turned))
    assert np.allclose([r.score for r in a], [r.score for r in b])


def test_odd_rows_and_clashing_columns(spark):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (4, 1), (6, 0), (8, 1), (8, 0), (10, 0), (None, 1), (7, None), (9, 5)], "doc_id bigint, quality int"
    )
    docs = edge_documents(spark).selectExpr("*", "1 as x", "2 as quality", "true as held_out")
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    same = {r.score for r in got if r.doc_id == 11}
    assert len(same) == 1
    assert quality.judged(no_documents(spark), labels).collect() == []
    model = quality.discriminant(*[quality.Sums(1.0, np.ones(15) * c, np.eye(15) + c * c) for c in (1, 2)], 0.5, 0.5)
    kept = quality.score(edge_documents(spark), model, "good")
    assert kept.columns == [*edge_documents(spark).columns, "good"] and kept.count() == len(TEXTS)
    with pytest.raises(ValueError):
        quality.score(docs, model, "x")


@pytest.mark.parametrize("label, expected", [(1, (0.5, 1)), (0, (0, 0.5)), (None, (0.5, 0.5))])
def test_one_class_or_none(spark, label, expected):
    labels = spark.createDataFrame([(1, label), (2, label)], "doc_id bigint, quality int")
    scores = {r.score for r in quality.judged(edge_documents(spark), labels).collect()}
    assert len(scores) == 1 and expected[0] <= scores.pop() <= expected[1]
