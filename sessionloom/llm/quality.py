"""Text quality by regularised quadratic discriminant analysis.

Every text becomes a row of statistics (lengths, shares of symbols, repeats, entropy), each put through a
root or a logarithm so that it is roughly bell-shaped; shares are smoothed so that short texts stay near
the rest. Each class gets a mean and a covariance from sums over all labelled rows. A class covariance is
drawn towards the pooled one and then towards a sphere; how far, and how steep the scores are, is what loses
least on five folds. A score is the difference of the two log densities, taken with triangular factors that
are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm import hashing
from sessionloom.llm.tables import id_remainder, table
from sessionloom.sources.scratch import materialise

FEATURES = (
    "words", "word_length", "word_length_spread", "letters", "capitals", "digits", "marks", "symbols",
    "foreign", "lines", "repeats", "commonest", "distinct", "pairs", "entropy",
)
FOLDS = 5
POOLED = (0.0, 0.1, 0.3, 0.6)  # share of the pooled covariance
SPHERE = (0.01, 0.05, 0.2, 0.5)  # share of the sphere
STEEP = (1.0, 0.5, 0.25, 0.125, 0.0625)  # factor of the log-density difference
FEW = 30  # rows of the rarer class below which folds say nothing
FEW_CHOICE = (0.3, 0.2, 0.25)

# Kinds of bytes: 0 white, 1 small letter, 2 capital, 3 digit, 4 mark of a sentence, 5 symbol, 6 not ASCII.
_KIND = np.full(256, 5, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[128:] = 6


def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of an array over the runs between consecutive starts."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[starts[1:]] - total[starts[:-1]]).astype(np.float64)


def _counts(keys: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text and how often its commonest key occurs."""
    distinct, most = np.zeros(texts), np.zeros(texts)
    if len(keys):
        order = np.lexsort((keys, text))
        k, t = keys[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])]))
        times = np.diff(np.append(first, len(k)))
        distinct = np.bincount(t[first], minlength=texts).astype(np.float64)
        np.maximum.at(most, t[first], times)
    return distinct, most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; null is an empty text."""
    data, starts = hashing.text_bytes(column)
    texts = len(starts) - 1
    kind = _KIND[data]
    size = _per_text(kind > 0, starts)
    share = {k: _per_text(kind == k, starts) / (size + 40) for k in range(1, 7)}
    first, end = hashing.word_bounds(data)
    word_starts = np.searchsorted(first, starts)
    words = np.diff(word_starts).astype(np.float64)
    text = np.repeat(np.arange(texts), np.diff(word_starts))
    hashes = hashing.word_hashes(data, first, end)
    length = np.log1p((end - first).astype(np.float64))
    mean = np.bincount(text, length, texts) / np.maximum(words, 1)
    square = np.bincount(text, length * length, texts) / np.maximum(words, 1)
    distinct, most = _counts(hashes, text, texts)
    again = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text[1:][again], minlength=texts) if len(text) > 1 else np.zeros(texts)
    joined = hashing.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[text[1:] == text[:-1]] if len(text) > 1 else hashes[:0]
    pair_text = text[1:][text[1:] == text[:-1]] if len(text) > 1 else text[:0]
    pairs, _ = _counts(joined, pair_text, texts)
    where = np.repeat(np.arange(texts), np.diff(starts))
    grid = np.bincount(where * 256 + data, minlength=texts * 256).reshape(texts, 256)[:, 33:].astype(np.float64)
    part = grid / np.maximum(grid.sum(1, keepdims=True), 1)
    entropy = -(part * np.log(np.where(part > 0, part, 1))).sum(1)
    return np.column_stack(
        [
            np.log1p(words),
            mean,
            np.sqrt(np.maximum(square - mean**2, 0)),
            share[1],
            np.sqrt(share[2]),
            np.sqrt(share[3]),
            np.sqrt(share[4]),
            np.sqrt(share[5]),
            np.sqrt(share[6]),
            np.sqrt(_per_text(data == 10, starts) / (words + 10)),
            np.sqrt(repeats / (words + 10)),
            np.sqrt(np.maximum(most - 1, 0) / (words + 10)),
            np.log((distinct + 5) / (words + 5)) / np.log(words + 10),
            np.log((pairs + 10) / (np.maximum(words - 1, 0) + 10)),
            entropy * size / (size + 10),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the scale of the columns."""

    scale: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    odds: float
    steep: float = 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0."""
        density = []
        for c in (0, 1):
            z = (x / self.scale - self.mean[c]) @ self.inverse[c].T
            density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + self.log_det[c]))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _chance(self.steep * self.difference(x) + self.odds)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


@dataclass(frozen=True)
class Sums:
    """Rows, sums and sums of products of one class."""

    n: float
    x: np.ndarray
    xx: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.x + other.x, self.xx + other.xx)

    @property
    def scatter(self) -> np.ndarray:
        return self.xx - np.outer(self.x, self.x) / max(self.n, 1)


def discriminant(zero: Sums, one: Sums, pooled: float, sphere: float, steep: float = 1.0) -> Discriminant:
    """The classes' Gaussians with shrunken covariances, in columns scaled by their pooled deviation."""
    both = (zero.scatter + one.scatter) / max(zero.n + one.n - 2, 1)
    scale = np.sqrt(np.where(np.diag(both) > 1e-12, np.diag(both), 1.0))
    width = len(scale)
    both = both / np.outer(scale, scale)
    mean, inverse, log_det = [], [], []
    for c in (zero, one):
        own = c.scatter / max(c.n - 1, 1) / np.outer(scale, scale)
        drawn = (1 - pooled) * own + pooled * both
        level = max(float(np.trace(drawn)) / width, 1e-3)
        factor = np.linalg.cholesky((1 - sphere) * drawn + sphere * level * np.eye(width))
        mean.append(c.x / max(c.n, 1) / scale)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    odds = float(np.log((one.n + 1) / (zero.n + 1)))
    return Discriminant(scale, np.array(mean), np.array(inverse), np.array(log_det), odds, steep)


def _constant(odds: float) -> Discriminant:
    """Without rows of both classes every score is the same."""
    width = len(FEATURES)
    return Discriminant(np.ones(width), np.zeros((2, width)), np.zeros((2, width, width)), np.zeros(2), odds)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` of every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                x = statistics(part.column("text"))
                flat = pa.array(x.ravel())
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "x"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _class_sums(labelled: DataFrame) -> dict[tuple[int, int], Sums]:
    """Sums by class and fold, partial in every task: ten rows reach the driver."""
    width = len(FEATURES)
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    x = lambda i: F.col("x")[i]
    rows = labelled.groupBy("quality", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(x(i)) for i in range(width)]).alias("x"),
        F.array(*[F.sum(x(i) * x(j)) for i, j in upper]).alias("xx"),
    )
    found = {}
    for r in rows.collect():
        square = np.zeros((width, width))
        for (i, j), v in zip(upper, r.xx):
            square[i, j] = square[j, i] = v
        found[r.quality, r.fold] = Sums(float(r.n), np.array(r.x), square)
    return found


def _fold_losses(labelled: DataFrame, models: dict[int, list[Discriminant]]) -> np.ndarray:
    """Log loss of every (shrinkage, steepness), each row judged by models that have not seen its fold."""
    many = len(POOLED) * len(SPHERE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros((many, len(STEEP)))
        for batch in batches:
            x = _matrix(batch.column("x"))
            y = batch.column("quality").to_numpy()
            fold = batch.column("fold").to_numpy()
            for f, choices in models.items():
                mine = fold == f
                if not mine.any():
                    continue
                sign = np.where(y[mine] == 1, 1.0, -1.0)
                for m, model in enumerate(choices):
                    d = model.difference(x[mine])
                    for s, steep in enumerate(STEEP):
                        loss[m, s] += np.logaddexp(0, -sign * (steep * d + model.odds)).sum()
        choice, steep = np.indices(loss.shape, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(choice.ravel()), pa.array(steep.ravel()), pa.array(loss.ravel())], names=["choice", "steep", "loss"]
        )

    total = np.zeros((many, len(STEEP)))
    lost = labelled.mapInArrow(run, "choice int, steep int, loss double").groupBy("choice", "steep").agg(F.sum("loss").alias("loss"))
    for r in lost.collect():  # one row per choice
        total[r.choice, r.steep] = r.loss
    return total


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the rows of ``stats`` (doc_id, x) that ``labels`` (doc_id, quality) mark with 0 or 1.

    All of them count, no sample is drawn. An id with several labels counts as 1 only if all are 1;
    rows that share an id each count. Without rows of both classes all scores are alike: near 1 or 0,
    or a half without any row.
    """
    marks = (
        labels.filter("quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = materialise(stats.join(marks, "doc_id").select("quality", fold, "x"), "labelled")
    sums = _class_sums(labelled)
    of = {c: [s for (k, _), s in sums.items() if k == c] for c in (0, 1)}
    total = {c: sum(s[1:], s[0]) for c, s in of.items() if s}
    if len(total) < 2:
        n = {c: total[c].n if c in total else 0.0 for c in (0, 1)}
        return _constant(float(np.log((n[1] + 1) / (n[0] + 1))))
    choices = list(product(POOLED, SPHERE))
    models = {}
    for f in range(FOLDS):
        rest = {c: [s for (k, g), s in sums.items() if k == c and g != f] for c in (0, 1)}
        if rest[0] and rest[1]:
            zero, one = (sum(rest[c][1:], rest[c][0]) for c in (0, 1))
            models[f] = [discriminant(zero, one, p, s) for p, s in choices]
    if min(total[0].n, total[1].n) < FEW or len(models) < FOLDS:
        pooled, sphere, steep = FEW_CHOICE
    else:
        loss = _fold_losses(labelled, models)
        m, s = np.unravel_index(int(loss.argmin()), loss.shape)
        (pooled, sphere), steep = choices[m], STEEP[s]
    return discriminant(total[0], total[1], pooled, sphere, steep)


def score(docs: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """The rows, all columns kept, with the chance that the text is good; a null text counts as empty.

    ``name`` must be new: a table that has such a column is refused.
    """
    columns = docs.columns
    if name in columns:
        raise ValueError(f"there is a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                found = pa.array(model.score(statistics(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], found], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Labels are learnt from the rows whose crc32(doc_id) modulo 5 is not 0. A null doc_id is not held out
    and has no label. Repeated rows are scored each. Empty texts have statistics, so they are scored too.
    Only doc_id, text and quality are looked at; no rows give none.
    """
    stats = materialise(text_statistics(docs), "statistics")
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(stats, labels.filter(~held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.score(_matrix(batch.column("x")))) if batch.num_rows else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op12_text_quality(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
