"""Vector codes of eight parts, trained by exact rounds of k-means over metric trees.

Vectors are cut into blocks of a bounded number of components. For every block and part a tree of balls is
built middle-out by the anchors hierarchy: about sqrt(n) anchors take the points nearest to them, a new
anchor starting at the point farthest from its own; the anchors' balls are then merged in pairs up to one
root, and an anchor with many points is divided again in the same way. A ball keeps the sum and the count of
its points. A round walks the trees with the list of entries that may still be nearest to some point of the
ball; children inherit the list and shorten it, and a ball with one entry left adds its cached sum and count
without looking at a point. Entries are dropped only when farther from every point than another, so the
rounds give what comparing every point with every entry would, in whole numbers.

The trees are written once, one row per block. A round sends only sums and counts per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.tables import table
from sessionloom.sources.scratch import materialise

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
LIMIT = float(1 << 16)  # components from here on would overflow a long when squared and summed
BLOCK = 1 << 17  # components in a block
LEAF = 48  # a ball of at most this many points is not divided
SLACK = 1e-9  # relative widening of balls, far above the rounding of double precision


@dataclass
class Tree:
    """Balls in preorder; a ball's points are ``order[start:end]``, a leaf has ``left`` -1."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.end - self.start


class _Ball:
    def __init__(self, points: np.ndarray, members: np.ndarray, total: np.ndarray | None = None, parts: tuple = ()):
        self.members, self.parts = members, parts
        self.total = points[members].sum(0) if total is None else total
        self.centre = self.total / len(members)
        away = points[members] - self.centre
        self.radius = float(np.sqrt(np.einsum("ij,ij->i", away, away).max()))


def _distance(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    away = points - at
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def anchors(points: np.ndarray, members: np.ndarray, many: int) -> list[np.ndarray]:
    """Members by nearest anchor. Points of an anchor stay sorted by distance, so that one stops looking for
    points to take where they are nearer than half the way to the new anchor."""
    first = _distance(points[members], points[members[0]])
    by = np.argsort(-first, kind="stable")
    pivots, owned, away = [members[0]], [members[by]], [first[by]]
    while len(pivots) < many:
        radius = np.array([d[0] for d in away])
        widest = int(radius.argmax())
        if radius[widest] == 0:
            break
        new = owned[widest][0]
        half = _distance(points[pivots], points[new]) / 2
        taken, their = [], []
        for i in np.flatnonzero(radius > half):
            reach = int(np.searchsorted(-away[i], -half[i]))
            d = _distance(points[owned[i][:reach]], points[new])
            nearer = d < away[i][:reach]
            if nearer.any():
                taken.append(owned[i][:reach][nearer])
                their.append(d[nearer])
                stay = np.ones(len(owned[i]), bool)
                stay[:reach] = ~nearer
                owned[i], away[i] = owned[i][stay], away[i][stay]
        got, dist = np.concatenate(taken), np.concatenate(their)
        by = np.argsort(-dist, kind="stable")
        pivots.append(new)
        owned.append(got[by])
        away.append(dist[by])
    return owned


def _divide(points: np.ndarray, members: np.ndarray) -> _Ball:
    if len(members) <= LEAF:
        return _Ball(points, members)
    owned = anchors(points, members, max(2, round(len(members) ** 0.5)))
    if len(owned) == 1:  # all points are equal
        return _Ball(points, members)
    balls = [_divide(points, own) for own in owned]
    centre = np.array([b.centre for b in balls])
    radius = np.array([b.radius for b in balls])
    cost = np.linalg.norm(centre[:, None] - centre[None], axis=2) + radius[:, None] + radius[None]
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(balls) - 1):
        i, j = divmod(int(cost.argmin()), len(balls))
        a, b = balls[i], balls[j]
        balls[i] = _Ball(points, np.concatenate([a.members, b.members]), a.total + b.total, (a, b))
        cost[j] = cost[:, j] = np.inf
        centre[i], radius[i], radius[j] = balls[i].centre, balls[i].radius, np.inf
        gap = np.linalg.norm(centre - centre[i], axis=1) + radius + radius[i]
        gap[i] = np.inf
        cost[i] = cost[:, i] = gap
        last = balls[i]
    return last


def build(points: np.ndarray) -> Tree:
    """The tree over the rows of an integer matrix."""
    root = _divide(points.astype(np.float64), np.arange(len(points)))
    balls: list[_Ball] = []
    start, end, left, right = [], [], [], []
    order: list[np.ndarray] = []

    todo = [(root, -1, False)]
    at = 0
    while todo:  # depth first, so that a ball's points are one run
        ball, parent, is_right = todo.pop()
        me = len(balls)
        balls.append(ball)
        start.append(at)
        end.append(at + len(ball.members))
        left.append(-1)
        right.append(-1)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        if ball.parts:
            todo += [(ball.parts[1], me, True), (ball.parts[0], me, False)]
        else:
            order.append(ball.members)
            at += len(ball.members)
    order_of = np.concatenate(order)
    sums = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order_of], axis=0, dtype=np.int64)])
    start_, end_ = np.array(start, np.int32), np.array(end, np.int32)
    return Tree(
        order_of.astype(np.int32),
        np.array([b.centre for b in balls]),
        np.array([b.radius for b in balls]) * (1 + SLACK) + SLACK,
        sums[end_] - sums[start_],
        start_,
        end_,
        np.array(left, np.int32),
        np.array(right, np.int32),
    )


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower one on a tie, and the squared distance, in whole numbers."""
    best = np.zeros(len(points), np.int64)
    least = np.full(len(points), np.iinfo(np.int64).max)
    for k, entry in enumerate(entries):
        away = points - entry
        d = np.einsum("ij,ij->i", away, away)
        nearer = d < least
        best[nearer], least[nearer] = k, d[nearer]
    return best, least


def walk(tree: Tree, points: np.ndarray, entries: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums and counts of the points nearest to each entry, and how many points were looked at.

    With ``codes`` the entry of every point is stored there too.
    """
    sums = np.zeros(entries.shape, np.int64)
    counts = np.zeros(len(entries), np.int64)
    place = entries.astype(np.float64)
    here, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    looked = 0
    while len(here):
        d = np.sqrt(((tree.centre[here][:, None] - place[None]) ** 2).sum(2))
        d[~open_] = np.inf
        reach = d.min(1) + 2 * tree.radius[here]
        open_ &= d <= (reach * (1 + SLACK) + SLACK)[:, None]
        owner = np.where(open_.sum(1) == 1, open_.argmax(1), -1)
        whole = owner >= 0
        np.add.at(sums, owner[whole], tree.total[here[whole]])
        np.add.at(counts, owner[whole], tree.count[here[whole]])
        if codes is not None:
            for ball, k in zip(here[whole], owner[whole]):
                codes[tree.order[tree.start[ball] : tree.end[ball]]] = k
        leaf = ~whole & (tree.left[here] < 0)
        for ball, mine in zip(here[leaf], open_[leaf]):
            listed = np.flatnonzero(mine)
            rows = tree.order[tree.start[ball] : tree.end[ball]]
            own = points[rows]
            looked += len(rows)
            found = listed[nearest(own, entries[listed])[0]]
            np.add.at(sums, found, own)
            counts += np.bincount(found, minlength=len(entries))
            if codes is not None:
                codes[rows] = found
        split = ~whole & ~leaf
        here, open_ = np.concatenate([tree.left[here[split]], tree.right[here[split]]]), np.vstack([open_[split]] * 2)
    return sums, counts, looked


_ARRAYS = {
    "order": np.int32, "centre": np.float64, "radius": np.float64, "total": np.int64,
    "start": np.int32, "end": np.int32, "left": np.int32, "right": np.int32,
}


def _pack(tree: Tree) -> dict[str, bytes]:
    return {name: np.ascontiguousarray(getattr(tree, name), kind).tobytes() for name, kind in _ARRAYS.items()}


def _unpack(packed: dict[str, bytes], width: int) -> Tree:
    found = {name: np.frombuffer(packed[name], kind) for name, kind in _ARRAYS.items()}
    found["centre"] = found["centre"].reshape(-1, width)
    found["total"] = found["total"].reshape(-1, width)
    return Tree(**found)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that count, components as whole numbers."""
    x = F.col("embedding")
    usable = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding").filter(
        x.isNotNull() & F.coalesce(usable, F.lit(False))
    )
    floor = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    return kept.select("vec_id", "label", floor.alias("v"))


def _blocks(numbers: DataFrame, size: int, block: int) -> DataFrame:
    """One row per block: ids, labels, the components and a packed tree per part."""
    width = size // PARTS
    rows_in_block = max(LEAF, block // max(size, 1))
    packed = T.StructType([T.StructField(name, T.BinaryType()) for name in _ARRAYS])
    schema = T.StructType(
        [
            T.StructField("vec_ids", T.ArrayType(T.LongType())),
            T.StructField("labels", T.ArrayType(numbers.schema["label"].dataType)),
            T.StructField("points", T.BinaryType()),
            T.StructField("trees", T.ArrayType(packed)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_in_block):
                part = batch.slice(at, rows_in_block)
                v = part.column("v")
                lengths = np.diff(v.offsets.to_numpy())
                flat = v.flatten().to_numpy(zero_copy_only=False)
                points = np.zeros((part.num_rows, size), np.int32)
                inside = np.arange(size)[None] < lengths[:, None]
                points[inside] = flat
                trees = [_pack(build(points[:, p * width : (p + 1) * width].astype(np.int64))) for p in range(PARTS)]
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(one, part.column("vec_id")),
                        pa.ListArray.from_arrays(one, part.column("label")),
                        pa.array([points.tobytes()]),
                        pa.array([trees], pa.list_(pa.struct([(name, pa.binary()) for name in _ARRAYS]))),
                    ],
                    names=["vec_ids", "labels", "points", "trees"],
                )

    return materialise(numbers.select("vec_id", "label", "v").mapInArrow(run, schema), "blocks")


def _each_part(row: dict, size: int) -> Iterator[tuple[int, Tree, np.ndarray]]:
    width = size // PARTS
    points = np.frombuffer(row["points"], np.int32).reshape(-1, size)
    for p, packed in enumerate(row["trees"]):
        yield p, _unpack(packed, width), points[:, p * width : (p + 1) * width].astype(np.int64)


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry moved to the floor of the mean of its parts; one without parts stays.

    ``books`` is (part, entry, component). A task sends one row per number of a codebook.
    """
    parts, many, width = books.shape
    size = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(books.shape, np.int64)
        counts = np.zeros((parts, many), np.int64)
        for batch in batches:
            for row in batch.select(["points", "trees"]).to_pylist():
                for p, tree, points in _each_part(row, size):
                    s, c, _ = walk(tree, points, books[p])
                    sums[p] += s
                    counts[p] += c
        all_of = np.concatenate([sums, counts[:, :, None]], axis=2)
        part, entry, place = np.indices(all_of.shape, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.ravel()) for a in (part, entry, place, all_of)], names=["part", "entry", "place", "total"]
        )

    partial = blocks.select("points", "trees").mapInArrow(run, "part int, entry int, place int, total bigint")
    found = partial.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {(r.part, r.entry, r.place): int(r.total) for r in found.collect()}  # the size of the codebooks
    moved = books.copy()
    for p in range(parts):
        for k in range(many):
            n = totals.get((p, k, width), 0)
            if n:
                moved[p, k] = [totals[p, k, j] // n for j in range(width)]
    return moved


def _encode(blocks: DataFrame, books: np.ndarray, label: T.DataType) -> DataFrame:
    """``(vec_id, label, code, error)`` of every vector."""
    size = books.shape[0] * books.shape[2]
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("label", label),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.select(["points", "trees"]).to_pylist()[0]
                codes, error = [], 0
                for p, tree, points in _each_part(row, size):
                    mine = np.zeros(len(points), np.int64)
                    walk(tree, points, books[p], mine)
                    away = points - books[p][mine]
                    error = error + np.einsum("ij,ij->i", away, away)
                    codes.append(mine)
                two = np.array([f"{k:02x}" for k in range(books.shape[1])], dtype=object)
                text = two[codes[0]]
                for mine in codes[1:]:
                    text = text + two[mine]
                yield pa.RecordBatch.from_arrays(
                    [one.column("vec_ids").flatten(), one.column("labels").flatten(), pa.array(text, pa.string()), pa.array(error)],
                    names=schema.names,
                )

    return blocks.mapInArrow(run, schema)


def _columns(codes: DataFrame, digest: str) -> DataFrame:
    """Errors summed per label, brought back to the rows. Sums are combined before the shuffle; their table is
    joined by its written size, and AQE cuts a label that many vectors share."""
    sums = materialise(codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label_errors")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, block: int = BLOCK) -> DataFrame:
    """Codes, errors and the codebooks' digest for every row of (vec_id, embedding, label) that counts.

    Rows drop out whose vector is null or has a null or non-finite component, or one of magnitude LIMIT
    or more, whose squared error a long may not hold. Shorter vectors count as filled with zeros to the
    longest, and that to a multiple of eight; an empty vector is all zeros. Rows with a null vec_id are
    coded but come last when the codebooks are started. Fewer than ``entries`` rows give codebooks of as
    many entries; equal ids start in the order of their vectors. No rows give none. Other columns are
    not looked at.
    """
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors)
    longest = numbers.agg(F.max(F.size("v"))).first()[0]
    schema = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if longest is None:
        return spark.createDataFrame([], schema)
    size = max(PARTS, -(-longest // PARTS) * PARTS)
    order: list[Column] = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = numbers.select("vec_id", "v").orderBy(*order).limit(entries).collect()
    start = np.zeros((len(first), size), np.int64)
    for row, r in zip(start, first):
        row[: len(r.v)] = r.v
    books = np.ascontiguousarray(start.reshape(len(first), PARTS, size // PARTS).transpose(1, 0, 2))
    blocks = _blocks(numbers, size, block)
    for _ in range(rounds):
        books = _round(blocks, books)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    return _columns(materialise(_encode(blocks, books, numbers.schema["label"].dataType), "codes"), digest)


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


# SQL twin: every part against every entry, in rounds.
def _sql_assign(number: int) -> str:
    return f"""
a{number} AS MATERIALIZED (
  SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.id, p.part, c.entry, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d
    FROM points p JOIN c{number} c ON c.part = p.part AND c.place = p.place GROUP BY p.id, p.part, c.entry)
  GROUP BY id, part)"""


def _sql_move(number: int) -> str:
    return f"""
c{number + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.place, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM c{number} c LEFT JOIN (
    SELECT a.part, a.entry, p.place, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n
    FROM a{number} a JOIN points p ON p.id = a.id AND p.part = a.part GROUP BY ALL) m
  ON m.part = c.part AND m.entry = c.entry AND m.place = c.place)"""


_ROUNDS_SQL = ",".join(f"{_sql_assign(i)},{_sql_move(i)}" for i in range(ROUNDS))

ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT max(len(v)) // {PARTS} AS w FROM kept),
long AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM kept),
points AS MATERIALIZED (SELECT id, pos // w AS part, pos % w AS place, x FROM long, wide),
c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, place, x FROM points WHERE id <= {ENTRIES}),
{_ROUNDS_SQL},{_sql_assign(ROUNDS)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} JOIN kept USING (id) GROUP BY id, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded"""
