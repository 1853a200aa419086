"""Toxic text by a support vector machine over a gapped-subsequence string kernel.

A sentence is read as its words; letters set apart by blanks ("i d i o t") are one word, and signs inside
a word do not count. The kernel of two words is the inner product of their three-letter subsequences
of span up to 8, each weighted DECAY to the power of its span, over factors that depend on the word
lengths alone. Landmarks chosen by pivoted Cholesky give the Nystroem features on which a linear
machine with squared hinge loss is trained. Its decision is a weighted sum of kernels with the landmarks, so
it is one weight per subsequence: words are scored by table look-ups, and a text by its worst word.

Documents are labelled, words are not: training starts from words much commoner in toxic documents,
then takes the worst word of each toxic document as toxic and of each clean one as clean, in turns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm import hashing
from sessionloom.llm.tables import id_remainder
from sessionloom.sources.scratch import materialise

SAMPLE = 4000  # labelled documents of each class used for training
DECAY = 0.6
SPAN = 8
WORST = 3  # words of a text that count
LEAST = -1.5  # decisions below it are all the same
WINDOW = 16  # longer words are read as overlapping windows
LETTERS = 68
_BLANK, _SIGN = 254, 255


def _letter_codes() -> np.ndarray:
    """Bytes to letters: case folded, signs and UTF-8 lead bytes marked."""
    code = np.full(256, _SIGN, np.uint8)
    code[[0x20, *range(0x09, 0x0E)]] = _BLANK
    code[np.arange(ord("a"), ord("z") + 1)] = np.arange(26)
    code[np.arange(ord("A"), ord("Z") + 1)] = np.arange(26)
    code[np.arange(ord("0"), ord("9") + 1)] = np.arange(26, 36)
    code[0x80:0xC0] = 36 + (np.arange(0x80, 0xC0) & 0x1F)
    return code


_CODE = _letter_codes()
_GAPS = [(i, j, DECAY ** (i + j + 1)) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]
_SCALE = np.array(
    [1.0] + [max(1e-9, sum(g * g * max(0, n - i - j) for i, j, g in _GAPS)) ** 0.5 for n in range(1, WINDOW + 1)]
)
_SCALE[:3] = 1.0


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts; start and length of each unit (word or window); text of each unit."""
    data, starts = hashing.text_bytes(column)
    code = _CODE[data]
    blank = code == _BLANK
    at = np.flatnonzero(code < LETTERS)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none.astype(np.uint8), none, none, none
    letters = code[at]
    word = np.cumsum(blank)[at]
    new = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(np.append(new, len(at)))
    text = np.searchsorted(starts, at[new], "right") - 1
    lone = size == 1
    joined = np.zeros(len(new), bool)
    joined[1:] = lone[1:] & lone[:-1] & (text[1:] == text[:-1])
    new, text = new[~joined], text[~joined]
    size = np.diff(np.append(new, len(at)))
    step = WINDOW // 2
    pieces = np.where(size > WINDOW, -(-(size - WINDOW) // step) + 1, 1)
    owner = np.repeat(np.arange(len(new)), pieces)
    inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = new[owner] + inner * step
    return letters, first, np.minimum(size[owner] - inner * step, WINDOW), text[owner]


def _laid_out(letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the units one after the other, the unit of each, and how many follow it in its unit."""
    unit = np.repeat(np.arange(len(first)), size)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return letters[first[unit] + inner].astype(np.int64), unit, size[unit] - 1 - inner


def _subsequences(laid: np.ndarray, unit: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    for i, j, weight in _GAPS:
        at = np.flatnonzero(rest >= i + j)
        yield unit[at], (laid[at] * LETTERS + laid[at + i]) * LETTERS + laid[at + i + j], weight


def _decisions(letters, first, size, table: np.ndarray, bias: float) -> np.ndarray:
    laid, unit, rest = _laid_out(letters, first, size)
    out = np.zeros(len(first))
    for owner, code, weight in _subsequences(laid, unit, rest):
        out += weight * np.bincount(owner, table[code], len(first))
    return out / _SCALE[size] + bias


def worst_units(column: pa.Array, table: np.ndarray, bias: float) -> tuple[np.ndarray, list[bytes]]:
    """Per text the WORST largest decisions of its units, filled up with LEAST, and the letters of the first."""
    letters, first, size, text = units(column)
    best, who = np.full((len(column), WORST), LEAST), [b""] * len(column)
    if not len(first):
        return best, who
    key = hashing.word_hashes(letters, first, first + size)
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    value = _decisions(letters, first[one], size[one], table, bias)[back]
    order = np.lexsort((-value, text))
    owner = text[order]
    place = np.arange(len(order)) - np.searchsorted(owner, owner)
    for n in range(WORST):
        u = order[place == n]
        best[text[u], n] = np.maximum(value[u], LEAST)
    for u in order[place == 0]:
        who[text[u]] = letters[first[u] : first[u] + size[u]].tobytes()
    return best, who


class Machine:
    """The trained classifier: a weight per subsequence, a bias, and the logistic link to a probability."""

    def __init__(self, table: np.ndarray, bias: float, slope: np.ndarray, shift: float):
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift

    def score(self, column: pa.Array) -> np.ndarray:
        best, _ = worst_units(column, self.table, self.bias)
        return 1.0 / (1.0 + np.exp(-np.clip(best @ self.slope + self.shift, -40, 40)))


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences that occur, then word, subsequence and weight of each occurrence."""
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer(b"".join(words), np.uint8)
    laid, unit, rest = _laid_out(letters, np.cumsum(size) - size, size)
    found = list(_subsequences(laid, unit, rest))
    codes = np.concatenate([c for _, c, _ in found])
    kinds, place = np.unique(codes, return_inverse=True)
    weight = np.concatenate([np.full(len(c), w) for _, c, w in found])
    owner = np.concatenate([u for u, _, _ in found])
    return kinds, owner, place, weight / _SCALE[size[owner]]


def train(
    words: list[bytes], toxic: np.ndarray, cost: np.ndarray, landmarks: tuple[int, int] = (256, 256)
) -> tuple[np.ndarray, float]:
    """Table and bias of the machine for words (letter codes), their labels and costs.

    Landmarks are drawn from the toxic words first and then from the clean ones.
    """
    kinds, owner, place, weight = _features(words)
    n = len(words)
    order = np.lexsort((place, owner))
    owner, place, weight = owner[order], place[order], weight[order]
    starts = np.searchsorted(owner, np.arange(n + 1))

    def against(i: int) -> np.ndarray:
        dense = np.zeros(len(kinds))
        mine = slice(starts[i], starts[i + 1])
        np.add.at(dense, place[mine], weight[mine])
        return np.bincount(owner, weight * dense[place], n)

    diagonal = np.zeros(n)
    pair = owner * np.int64(len(kinds)) + place
    values, back = np.unique(pair, return_inverse=True)
    np.add.at(diagonal, values // len(kinds), np.bincount(back, weight) ** 2)
    left, chosen = diagonal.copy(), []
    half = np.zeros((n, sum(landmarks)))
    for most, of in zip(landmarks, (toxic, ~toxic), strict=True):
        for _ in range(most):  # pivoted Cholesky: the word worst explained so far
            i, r = int(np.argmax(np.where(of, left, -1.0))), len(chosen)
            if left[i] < 1e-3 or not of[i]:
                break
            half[:, r] = (against(i) - half[:, :r] @ half[i, :r]) / left[i] ** 0.5
            left = np.maximum(0.0, left - half[:, r] ** 2)
            chosen.append(i)
    half = half[:, : len(chosen)]
    x = np.hstack([half, np.ones((n, 1))])
    y = np.where(toxic, 1.0, -1.0)
    v = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(20):  # Newton steps on the squared hinge
        gap = 1.0 - y * (x @ v)
        active = gap > 0
        xa, ca = x[active], cost[active]
        slope = ridge * v - xa.T @ (ca * y[active] * gap[active])
        step = np.linalg.solve(np.diag(ridge) + (xa.T * ca) @ xa, slope)
        v -= step
        if np.abs(step).max() < 1e-5:
            break
    lower = half[chosen]
    alpha = np.linalg.solve(lower.T, v[:-1])  # features of a word are the inverse of lower times its kernels
    table = np.zeros(LETTERS**3)
    for a, i in zip(alpha, chosen, strict=True):
        mine = slice(starts[i], starts[i + 1])
        np.add.at(table, kinds[place[mine]], a * weight[mine])
    return table, float(v[-1])


def _words_of(docs: DataFrame) -> DataFrame:
    """(word, toxic) once per document; words as letter codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                letters, first, size, text = units(part.column("text"))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                use = size >= 3
                first, size, text = first[use], size[use], text[use]
                key = hashing.word_hashes(letters, first, first + size)
                _, one = np.unique(key ^ hashing.mix(text.astype(np.uint64)), return_index=True)
                found = [letters[first[u] : first[u] + size[u]].tobytes() for u in one]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), pa.array(toxic[text[one]].astype(np.int32))], names=["word", "toxic"]
                )

    return docs.select("text", "toxic").mapInArrow(run, "word binary, toxic int")


def _worst(docs: DataFrame, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Label, decision and worst word of each sampled document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                best, who = worst_units(part.column("text"), shared.value, bias)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), pa.array(list(best)), pa.array(who, pa.binary())],
                    names=["doc_id", "toxic", "best", "word"],
                )

    rows = (
        docs.select("doc_id", "text", "toxic")
        .mapInArrow(run, "doc_id bigint, toxic int, best array<double>, word binary")
        .orderBy("doc_id", "word")
        .collect()
    )
    return np.array([r.toxic for r in rows]), np.array([r.best for r in rows]).reshape(-1, WORST), [bytes(r.word) for r in rows]


def _logistic(best: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the probability, with smoothed targets."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    aim = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([best, np.ones((len(best), 1))])
    v = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(v))
        step = np.linalg.solve(hessian, x.T @ (p - aim) + 1e-2 * v)
        v -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return v[:-1], float(v[-1])


def _turn(toxic: Counter, clean: Counter) -> tuple[np.ndarray, float]:
    """Train on words counted in toxic and in clean documents; each class weighs the same."""
    words = [*sorted(toxic), *sorted(clean)]
    label = np.array([True] * len(toxic) + [False] * len(clean))
    times = np.array([(toxic if y else clean)[w] for w, y in zip(words, label, strict=True)], float) ** 0.5
    cost = np.where(label, 0.5 / max(1.0, times[label].sum()), 0.5 / max(1.0, times[~label].sum())) * times
    return train(words, label, cost * 100.0 * len(words))


def fit(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE, turns: int = 5, start: int = 400) -> Machine:
    """Train on the texts (doc_id, text) that labels (doc_id, toxic) mark.

    At most ``sample`` documents of each class are used, chosen by the md5 of doc_id; their ids, at most
    twice ``sample``, are broadcast to the texts. The driver holds one word and WORST numbers per sampled
    document, and at most ``start`` toxic and 13 times as many clean words. Labels repeated for an id
    count once, as toxic if any is. With no toxic or no clean document every score is near 0, or 1.
    """
    marks = (
        labels.filter("toxic in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .join(texts.select("doc_id"), "doc_id", "left_semi")
        .withColumn("__by", F.md5(F.col("doc_id").cast("string").cast("binary")))
    )
    parts = [marks.filter(f"toxic = {c}").orderBy("__by", "doc_id").limit(sample) for c in (0, 1)]
    chosen = materialise(parts[0].union(parts[1]).drop("__by"), "chosen")
    drawn = materialise(
        texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .repartition(12, "doc_id"),
        "labelled",
    )
    counts = {r.toxic: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return Machine(np.zeros(LETTERS**3), 0.0, np.zeros(WORST), 40.0 if n1 else -40.0)
    words = materialise(
        _words_of(drawn).groupBy("word").agg(
            F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.md5("word").alias("by")
        ),
        "words",
    )
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (n1 + 1 - t)) - F.log(c / (n0 + 1 - c))
    surprise = odds / F.sqrt(1 / t + 1 / c)
    ranked = words.filter("t > 1").withColumn("z", surprise).orderBy(F.desc("z"), "by").limit(start).collect()
    toxic = Counter({bytes(r.word): r.t for r in ranked if r.z >= 3.5} or {bytes(r.word): r.t for r in ranked[:40]})
    if not toxic:
        return Machine(np.zeros(LETTERS**3), 0.0, np.zeros(WORST), float(np.log((n1 + 1) / (n0 + 1))))
    some = words.filter("c > 0").orderBy("by").limit(10 * start).collect()
    frequent = words.filter("c > 0").orderBy(F.desc("c"), "by").limit(2 * start).collect()
    clean = Counter({bytes(r.word): r.c for r in (*some, *frequent)})
    clean |= Counter({bytes(r.word): r.c for r in ranked if r.c})
    for turn in range(turns):
        table, bias = _turn(toxic, clean)
        y, best, worst = _worst(drawn, table, bias)
        if turn < turns - 1:
            toxic = Counter(w for w, k, b in zip(worst, y, best, strict=True) if k and len(w) > 2 and b[0] > -0.5) or toxic
            clean |= Counter(w for w, k in zip(worst, y, strict=True) if not k and len(w) > 2)
    return Machine(table, bias, *_logistic(best, y))


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """The rows, all columns kept, with the probability that the text is toxic; a null text counts as empty.

    ``name`` must be new: a table that has such a column is refused.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.table, machine.bias, machine.slope, machine.shift))
    columns = docs.columns
    if name in columns:
        raise ValueError(f"there is a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine(*shared.value)
        for batch in batches:
            for part in hashing.slices(batch):
                arrays = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.score(part.column("text")))], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Labels are learnt from the rows whose crc32(doc_id) modulo 3 is not 1. A null doc_id is not held out
    and has no label. Repeated rows are scored each.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    machine = fit(texts, labels.filter(~held), sample)
    slim = score(texts, machine).select("doc_id", "score")
    return slim.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
