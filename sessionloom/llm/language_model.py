"""Scoring texts with a deleted-interpolation bigram model.

P(w | h) = l2 c(h, w) / c(h) + l1 c(w) / N + l0 / (V + 1), with weights l by the frequency bucket of the
context h. The weights come from expectation-maximisation on held-out counts: each training document is
held out in turn, its own counts taken off those of the corpus.

Texts are tokenised once into chunks of a few million tokens, a table bucketed by chunk. A chunk asks for
the counts of its distinct words and bigrams once, packed by ranges of the key; the task of a range adds up
what all chunks counted and answers each in the order it asked in. Questions grow with the distinct
bigrams of chunks, answers are about a byte per question, and no chunk is shuffled: both tables
are bucketed alike, so the passes that learn the weights and that score join them where they lie.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import hashing
from sessionloom.sources.scratch import materialise, scratch_path

CHUNK = 2_000_000  # tokens of a chunk, and keys of a range; a longer text is a chunk of its own
BUCKETS = 16  # context frequency buckets, doubling
_FINE = 4  # cells per doubling in the counts that the weights are learnt from
_LEVELS = 256  # cells per probability; level 0 is probability 0
_BLOCK = 1 << 17  # tokens that are computed at once, which bounds the arrays of a task
_END = np.uint64(0x9D5E3C1B7A2F4E81)
_START = np.uint64(0x5B8A1F3E7C9D2461)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (_ZSTD.compress(planes, asbytes=True) if planes else b"")


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = _ZSTD.decompress(data[8:], n * width, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(kind).reshape(n)


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


_CHUNK_COLUMNS = "chunk bigint, ids binary, known binary, sizes binary, words binary, places binary"


def chunks(docs: DataFrame, tokens: int = CHUNK) -> DataFrame:
    """One row per chunk: ids of its texts, their sizes in words, distinct words, and the word at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held = TaskContext.get().partitionId(), 0, []

        def row() -> pa.RecordBatch:
            ids, sizes, words = (np.concatenate([h[k] for h in held]) for k in range(3))
            known = np.concatenate([h[3] for h in held])
            distinct, places = np.unique(words, return_inverse=True)
            cells = [
                ids.tobytes(), known.tobytes(), _pack(sizes.astype(np.uint32)), distinct.tobytes(),
                _pack(places.reshape(-1).astype(np.uint32)),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | n], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]],
                names=["chunk", "ids", "known", "sizes", "words", "places"],
            )

        size = 0
        for batch in batches:
            for part in hashing.slices(batch):
                data, starts = hashing.text_bytes(part.column("text"))
                data = _LOWER[data]
                first, end = hashing.word_bounds(data)
                sizes = np.diff(np.searchsorted(first, starts))
                ids = part.column("id")
                held.append(
                    (
                        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes,
                        hashing.word_hashes(data, first, end), ids.is_valid().to_numpy(zero_copy_only=False),
                    )
                )
                size += len(first)
                if size >= tokens:
                    yield row()
                    held, size, n = [], 0, n + 1
        if held:
            yield row()

    return docs.select("id", "text").mapInArrow(run, _CHUNK_COLUMNS)


class _Chunk:
    """Token stream of a chunk: its texts' words, each text followed by an end."""

    def __init__(self, row):
        ids, known = np.frombuffer(row.ids, np.int64), np.frombuffer(row.known, bool)
        self.ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        sizes = _unpack(row.sizes, np.uint32).astype(np.int64)
        self.held_out = np.array([is_held_out(i) for i in self.ids], bool)
        self.words = np.append(np.frombuffer(row.words, np.uint64), _END)  # the end is the last word
        n = int(sizes.sum()) + len(sizes)
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        self.last = np.cumsum(sizes + 1) - 1
        self.word = np.full(n, len(self.words) - 1, np.int32)
        inside = np.ones(n, bool)
        inside[self.last] = False
        self.word[inside] = _unpack(row.places, np.uint32)
        self.previous = np.roll(self.word, 1)  # the end of another text before a text's first word
        keys = self.words[self.previous]
        keys[self.last - sizes] = _START
        keys = hashing.mix(hashing.mix(keys * _PAIR) + self.words[self.word])
        self.pairs, pair = np.unique(keys, return_inverse=True)
        self.pair = pair.reshape(-1).astype(np.int32)
        self.sizes = sizes
        self.train = ~self.held_out[self.text]

    def questions(self) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """Sorted keys and this chunk's training counts, of words (without the end) and of bigrams."""
        words = np.bincount(self.word[self.train], minlength=len(self.words))[:-1]
        pairs = np.bincount(self.pair[self.train], minlength=len(self.pairs))
        return [("w", self.words[:-1], words), ("p", self.pairs, pairs)]


def _ask(table: DataFrame, ranges: int) -> DataFrame:
    """(kind, part, chunk, keys, counts): the questions of every chunk to every range of keys it has some in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = [(2**64 * n) // ranges for n in range(1, ranges)]
        borders = np.array(borders, np.uint64)
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                out = []
                for kind, keys, counts in _Chunk(row).questions():
                    cut = [0, *np.searchsorted(keys, borders), len(keys)]
                    for n in range(ranges):
                        a, b = cut[n], cut[n + 1]
                        if a < b:
                            gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                            out.append((kind, n, row.chunk, _pack(gaps), _pack(counts[a:b].astype(np.uint32))))
                if out:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(("kind", "part", "chunk", "keys", "counts"), o, strict=True)) for o in out],
                        schema=pa.schema(
                            [("kind", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
                        ),
                    )

    return table.mapInArrow(run, "kind string, part int, chunk bigint, keys binary, counts binary")


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of one range for every chunk that asked, and the number of keys seen in training."""
    pdf = pdf.sort_values("chunk")
    keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in pdf["keys"]]
    counts = np.concatenate([_unpack(c, np.uint32) for c in pdf["counts"]])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, counts).astype(np.int64)
    answers = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
    kind, part = pdf["kind"].iloc[0], int(pdf["part"].iloc[0])
    rows = [(kind, part, c, _pack(a), 0) for c, a in zip(pdf["chunk"], answers, strict=True)]
    rows.append((kind, part, -1, b"", int((total > 0).sum())))
    return pd.DataFrame(rows, columns=["kind", "part", "chunk", "answer", "seen"])


class _Facts:
    """A chunk with the corpus counts of its tokens."""

    def __init__(self, row, answers: pd.DataFrame, train_texts: int):
        self.chunk = _Chunk(row)
        answers = answers.sort_values("part")
        self.pairs, words = (
            np.concatenate([_unpack(a, np.int64) for a in answers["answer"][answers["kind"] == kind]] or [np.zeros(0, np.int64)])
            for kind in ("p", "w")
        )
        self.words = np.append(words, train_texts)  # an end is the last word, and as frequent as a start

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Places of some tokens, and the corpus counts of their bigrams, contexts and words."""
        c = self.chunk
        for a in range(0, len(c.word), _BLOCK):
            at = slice(a, a + _BLOCK)
            yield at, self.pairs[c.pair[at]], self.words[c.previous[at]], self.words[c.word[at]]

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often the bigram, context and word of each token come in its own text."""
        c = self.chunk

        def times(key: np.ndarray, spread: int) -> np.ndarray:
            _, back, n = np.unique(c.text.astype(np.int64) * spread + key, return_inverse=True, return_counts=True)
            return n.astype(np.int32)[back.reshape(-1)]

        word = times(c.word, len(c.words))
        return times(c.pair, len(c.pairs)), np.roll(word, 1), word


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1.0))).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    """Probabilities on a logarithmic scale; 0 stays 0."""
    level = np.round(-np.log2(np.maximum(p, 1e-300)) * _FINE) + 1
    return np.where(p > 0, np.minimum(level, _LEVELS - 1), 0).astype(np.int64)


def learn_weights(cells: pd.DataFrame, unseen: float, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, 3) by expectation-maximisation; ``cells`` count held-out tokens by bucket and probabilities."""
    weights = np.full((BUCKETS, 3), 1.0 / 3)
    scale = np.append(0.0, 2.0 ** (-np.arange(_LEVELS - 1) / _FINE))
    b, n = cells["bucket"].to_numpy(), cells["n"].to_numpy(float)
    p = np.stack([scale[cells["two"].to_numpy()], scale[cells["one"].to_numpy()], np.full(len(cells), unseen)], axis=1)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        for k in range(3):
            weights[:, k] = np.bincount(b, share[:, k], BUCKETS) + 1e-3
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def _bucketed(df: DataFrame, buckets: int, label: str) -> str:
    """Write a table bucketed by chunk below the scratch folder; returns its name."""
    name = f"lm_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "chunk").option("path", scratch_path(df.sparkSession, label)).saveAsTable(name)
    return name


def score_texts(docs: DataFrame, tokens: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are lower-cased A to Z; a text's tokens are its words and one end. Counts come from the rows whose
    crc32(doc_id) modulo 7 is not 2; a null id is not held out. A null text counts as empty and has the end
    alone. Repeated rows are texts of their own. Without training tokens the base score is 0.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    first = materialise(chunks(slim, tokens), "chunks")
    n_chunks = max(1, first.count())
    table = _bucketed(first, n_chunks, "chunks")
    chunked = spark.table(table)
    ranges = max(8, n_chunks)
    asked = _ask(chunked, ranges)
    replies = "kind string, part int, chunk bigint, answer binary, seen bigint"
    answered = materialise(asked.groupBy("kind", "part").applyInPandas(_answer, replies), "answers")
    distinct = answered.filter("chunk = -1 and kind = 'w'").agg(F.sum("seen")).first()[0] or 0
    replied = _bucketed(
        answered.filter("chunk >= 0").drop("seen").repartition(n_chunks, "chunk"), n_chunks, "answers"
    )

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                c = _Chunk(row)
                yield pd.DataFrame({"texts": [int((~c.held_out).sum())], "tokens": [int(c.train.sum())]})

    totals = chunked.mapInPandas(sizes, "texts bigint, tokens bigint").agg(F.sum("texts"), F.sum("tokens")).first()
    train_texts, train_tokens = int(totals[0] or 0), int(totals[1] or 0)
    distinct += train_texts > 0
    unseen = 1.0 / (distinct + 1)
    pairs = chunked.groupBy("chunk").cogroup(spark.table(replied).groupBy("chunk"))

    def cells(one: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        f = _Facts(next(one.itertuples()), answers, train_texts)
        pair, before, own = f.own()
        n = np.zeros(BUCKETS * _LEVELS**2, np.int64)
        for at, both, context, word in f.blocks():
            t = f.chunk.train[at]
            both, context, word = (both - pair[at])[t], (context - before[at])[t], (word - own[at])[t]
            two, single = both / np.maximum(context, 1), word / max(1, train_tokens)
            n += np.bincount((_bucket(context) * _LEVELS + _level(two)) * _LEVELS + _level(single), minlength=len(n))
        code = np.flatnonzero(n)
        return pd.DataFrame({"bucket": code // _LEVELS**2, "two": code // _LEVELS % _LEVELS, "one": code % _LEVELS, "n": n[code]})

    by = ["bucket", "two", "one"]
    held_out = pairs.applyInPandas(cells, "bucket bigint, two bigint, one bigint, n bigint")
    weights = learn_weights(held_out.groupBy(*by).agg(F.sum("n").alias("n")).orderBy(*by).toPandas(), unseen)

    def scores(one: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        f = _Facts(next(one.itertuples()), answers, train_texts)
        c = f.chunk
        n = len(c.ids)
        base, score, known = np.zeros(n), np.zeros(n), np.zeros(n)
        for at, both, context, word in f.blocks():
            w, text = weights[_bucket(context)], c.text[at]
            two = both / np.maximum(context, 1)
            p = w[:, 0] * two + w[:, 1] * (word / max(1, train_tokens)) + w[:, 2] * unseen
            low = text[0]
            to = slice(low, text[-1] + 1)
            text = text - low
            base[to] += np.bincount(text, np.log10((word + 1) / (train_tokens + distinct + 1)))
            score[to] += np.bincount(text, np.log10(p))
            known[to] += np.bincount(text, word > 0)
        return pd.DataFrame(
            {
                "doc_id": pd.array(c.ids, "Int64"),
                "held_out": c.held_out,
                "n_tokens": c.sizes + 1,
                "n_known": known.astype(np.int64),
                "train_tokens": train_tokens,
                "base_score": base,
                "score": score,
            }
        )

    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = materialise(pairs.applyInPandas(scores, out), "scores")
    for name in (table, replied):
        spark.sql(f"DROP TABLE {name}")
    return scored
