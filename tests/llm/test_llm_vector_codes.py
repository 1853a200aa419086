"""Vector codes against plain k-means, and the balls against brute force."""

import hashlib
import math

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from sessionloom.llm import vector_codes as vc
from sessionloom.llm.tables import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, code string"


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) and abs(x) < vc.LIMIT for x in v)


def naive(rows, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if _usable(v)]
    if not kept:
        return []
    size = max(8, -(-max(len(v) for _, v, _ in kept) // 8) * 8)
    width = size // 8
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = np.array([v + [0] * (size - len(v)) for _, v, _ in kept], dtype=np.int64).reshape(len(kept), 8, width)
    books = [points[:entries, p].copy() for p in range(8)]

    def assign(p):
        d = ((points[:, p, None] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(8):
            who, _ = assign(p)
            for k in range(len(books[p])):
                if (who == k).any():
                    books[p][k] = [int(s) // int((who == k).sum()) for s in points[who == k, p].sum(0)]
    found = [assign(p) for p in range(8)]
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    errors = [int(sum(f[1][i] for f in found)) for i in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(
        ((r[0], "".join(f"{int(f[0][i]):02x}" for f in found), errors[i], by_label[r[2]], digest) for i, r in enumerate(kept)),
        key=str,
    )


def _equal(df, **more):
    got = vc.compress(df, **more)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == naive(rows)


def test_whole_table(spark, sf_dir):
    _equal(table(spark, sf_dir, "embeddings"))


def test_small_blocks(spark):
    _equal(table(spark, "/root/testdata/sf0.01", "embeddings").repartition(3), block=64 * 50)


def test_sql_twin(spark, sf_dir):
    assert compare(vc.op11_vector_codes(spark, sf_dir), duck(sf_dir), vc.ORACLE) == ""


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 24)], i % 3) for i in range(120)]
    rows += [
        (500, None, 1), (501, [None] * 24, 1), (502, [float("nan")] * 24, 1), (503, [float("inf")] + [0.0] * 23, 1),
        (504, [], 1), (505, [0.0] * 24, None), (506, [0.5] * 5, None), (507, [1e30] * 24, 0), (508, [-0.1] * 21, 2),
        (509, [65535.0] * 24, 2), (None, [0.25] * 24, 2), (2**60 + 1, [0.3] * 24, 1), (2**60 + 3, [0.3] * 24, 1), (7, [0.1] * 24, 7),
    ]
    rows += [(3, rows[3][1], rows[3][2])] * 60  # repeated rows
    clash = [(*r, "x", "y") for r in rows]
    _equal(spark.createDataFrame(clash, SCHEMA).repartition(4))


@pytest.mark.parametrize("rows", [[], [(1, None, 2)], [(1, [0.1] * 8, 2)], [(i, [0.0] * 16, None) for i in range(100)]])
def test_few_or_equal_vectors(spark, rows):
    _equal(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))


def _spread(kind):
    rng = np.random.default_rng(8)
    if kind == "clusters":
        return (rng.integers(-9000, 9000, (12, 4))[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 4))).astype(np.int64)
    if kind == "ties":
        return rng.integers(-2, 3, (2000, 4)).astype(np.int64)
    return rng.integers(-4096, 4096, (2000, 4)).astype(np.int64)


@pytest.mark.parametrize("kind", ["clusters", "ties", "even"])
def test_balls_hold_their_points(kind):
    points = _spread(kind)
    tree = vc.build(points)
    assert sorted(tree.order) == list(range(len(points)))
    for ball in range(len(tree.radius)):
        rows = points[tree.order[tree.start[ball] : tree.end[ball]]]
        assert (tree.total[ball] == rows.sum(0)).all()
        assert np.linalg.norm(rows - tree.centre[ball], axis=1).max() <= tree.radius[ball]
        if tree.left[ball] >= 0:
            l, r = tree.left[ball], tree.right[ball]
            assert (tree.start[l], tree.end[l], tree.start[r], tree.end[r]) == (
                tree.start[ball], tree.start[r], tree.end[l], tree.end[ball],
            )
        else:
            assert tree.count[ball] <= vc.LEAF or (rows == rows[0]).all()


@pytest.mark.parametrize("kind", ["clusters", "ties", "even"])
def test_walk_equals_all_distances(kind):
    points = _spread(kind)
    tree, entries = vc.build(points), points[:16].copy()
    for _ in range(3):
        codes = np.full(len(points), -1)
        sums, counts, looked = vc.walk(tree, points, entries, codes)
        d = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (codes == d.argmin(1)).all()
        assert (counts == np.bincount(d.argmin(1), minlength=16)).all()
        for k in range(16):
            assert (sums[k] == points[codes == k].sum(0)).all()
        assert looked <= len(points)
        entries = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], entries)


def test_balls_of_one_entry_are_not_opened():
    rng = np.random.default_rng(8)
    centres = rng.integers(-9000, 9000, (16, 4))
    points = (centres[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 4))).astype(np.int64)
    _, counts, looked = vc.walk(vc.build(points), points, centres)
    assert counts.sum() == 3000 and looked < 300


def test_a_label_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8)], 1 if i % 3 == 0 else i, "", "") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _equal(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert vc.compress(df).select(F.countDistinct("codebooks_sha256")).first()[0] == 1
