"""Near-duplicate documents by DartMinHash signatures of weighted five-word shingles.

A shingle of weight x is a region of weight [0, x) and rank [0, inf) into which a hash throws darts, one
per unit of area on average; equal shingles get equal darts. A text keeps its darts of rank below
t / (its total weight), about t of them whatever its length; each dart falls on one of k coordinates and
the earliest dart of a coordinate is its sample. Two texts share a sample with the probability of
their weighted Jaccard similarity. Bands of samples propose pairs, and shared text decides them.

Within a band the texts are compared with one of them, the one that shares most bands: a group of copies
costs one comparison per copy. Bands whose texts this leaves in different components are open: every pair of
theirs that shares an open band and no component is compared too, so no link between groups is lost.
These texts are dealt, by the clusters that open bands make, to tasks of bounded size, which return one link
per pair of groups they join and never the pairs they looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import hashing
from sessionloom.llm.components import components
from sessionloom.sources.scratch import materialise

SHINGLE = 5
BANDS = 25
ROWS = 5
LIKE = 0.8
BLOCK = 1024  # texts of a side of a comparison task
_DART = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)


def _regions(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut regions at whole weights: element, number of the unit, and how much of it belongs."""
    units = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(weights)), units)
    unit = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
    return element, unit, np.minimum(weights[element] - unit, 1.0)


def dart_samples(keys: np.ndarray, weights: np.ndarray, text: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of weighted elements (64-bit key, weight > 0, number of the text).

    A sample is the rank of the earliest dart of the coordinate and 32 bits of its hash.
    """
    out = np.full((n, k), _NONE)
    flat = out.reshape(-1)
    total = np.bincount(text, weights, n)
    aim = np.full(n, k * (np.log(k) + 2.0))
    element, unit, part = _regions(weights)
    cell = hashing.mix(keys[element] + unit.astype(np.uint64) * _DART)
    owner = text[element]
    open_ = total > 0
    while open_.any():
        bound = np.where(open_, aim / np.maximum(total, 1e-300), 0.0)
        live = np.flatnonzero(open_[owner])
        c, t, p = cell[live], owner[live], part[live]
        rank = np.zeros(len(live))
        throw = 0
        while len(c):
            h = hashing.mix(c + np.uint64((2 * throw + 1) * int(_DART) % 2**64))
            rank = rank - np.log(hashing.uniform(h))
            keep = rank < bound[t]
            c, t, p, rank, h = c[keep], t[keep], p[keep], rank[keep], h[keep]
            g = hashing.mix(h ^ _DART)
            hit = hashing.uniform(hashing.mix(g)) < p
            at = t[hit] * k + (g[hit] % np.uint64(k)).astype(np.int64)
            early = rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            np.minimum.at(flat, at, early | (g[hit] >> np.uint64(32)))  # rank first: the earliest dart stays
            throw += 1
        open_ &= (out == _NONE).any(axis=1)
        out[open_] = _NONE
        aim = np.where(open_, aim * 2, aim)
    return out


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(id, bands): one 64-bit key per band, no bands for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64) * _DART
        for batch in batches:
            for part in hashing.slices(batch):
                found, made = hashing.shingles(*hashing.words(part.column("text")), shingle)
                text = np.repeat(np.arange(part.num_rows), made)
                cell = hashing.mix(found + hashing.occurrences(found, text).astype(np.uint64) * _DART)
                signature = dart_samples(cell, np.ones(len(cell)), text, part.num_rows, bands * rows)
                key = np.repeat(salt[None, :], part.num_rows, axis=0)
                for r in range(rows):
                    key = hashing.mix(key * _DART + signature[:, r::rows])
                some = made > 0
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "bands"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, bands array<bigint>")


def _weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.minimum(ca[ia], cb[ib]).sum()
    return float(both) / float(len(a) + len(b) - both)


def _shared_text(pairs: DataFrame, texts: DataFrame, like: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard similarity of at least ``like``."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch, "text_a"):
                sides = []
                for side in ("text_a", "text_b"):
                    found, made = hashing.shingles(*hashing.words(part.column(side)), shingle)
                    sides.append(np.split(found, np.cumsum(made)[:-1]))
                keep = [_weighted_jaccard(x, y) >= like for x, y in zip(*sides, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _deal(left: DataFrame, block: int) -> DataFrame:
    """(id, component, bands, key, side): each text in the tasks where it meets the others of its cluster.

    A cluster of up to ``block`` texts is in one task with other such clusters; a larger one is cut in blocks
    and each pair of blocks is a task.
    """
    hubs = left.groupBy("band").agg(F.min("id").alias("hub"))
    edges = left.select("band", "id").join(hubs, "band").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    clusters = materialise(components(edges).withColumnRenamed("component", "cluster"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    bins = max(1, clusters.count() * 2 // block)
    rows = left.groupBy("id", "component").agg(F.collect_list("band").alias("bands"))
    placed = rows.join(clusters, "id").join(sizes, "cluster")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    bin_ = F.pmod(F.xxhash64("cluster"), F.lit(bins))
    small = F.array(F.struct(F.concat(F.lit("s"), bin_).alias("key"), F.lit(0).alias("side")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda x: F.struct(
            F.concat_ws(":", "cluster", F.least(x, own), F.greatest(x, own)).alias("key"),
            F.when(x == own, 0).when(own < x, 1).otherwise(2).alias("side"),
        ),
    )
    return placed.select("id", "component", "bands", F.inline(F.when(F.col("blocks") == 1, small).otherwise(pairs)))


def _compare(like: float, shingle: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between components of the task's texts: side 0 with itself, or side 1 with side 2."""
        found, made = hashing.shingles(*hashing.words(pa.array(pdf["text"])), shingle)
        text = np.repeat(np.arange(len(pdf)), made)
        kinds, kind = np.unique(found, return_inverse=True)
        order = np.lexsort((kind, text))
        kind, text = kind[order], text[order]
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(kind)))
        kind, starts = kind[at], np.searchsorted(text[at], np.arange(len(pdf) + 1))
        side = pdf["side"].to_numpy()
        group = np.unique(pdf["component"], return_inverse=True)[1]
        band = np.concatenate(pdf["bands"].to_numpy())
        member = np.repeat(np.arange(len(pdf)), pdf["bands"].map(len))
        order = np.argsort(band, kind="stable")
        member, edge = member[order], np.flatnonzero(np.diff(band[order], prepend=band[order][:1] - 1))
        groups = np.split(member, edge[1:]) if len(edge) else []
        of = [[] for _ in range(len(pdf))]
        for g in groups:
            for x in g:
                of[x].append(g)
        dense = np.zeros(len(kinds), np.int64)
        links = []
        for x in range(len(pdf)):
            if not of[x] or side[x] == 2:
                continue
            y = np.unique(np.concatenate(of[x]))
            y = y[(y > x) if side[x] == 0 else (side[y] == 2)]
            y = y[group[y] != group[x]]
            small, large = np.minimum(made[y], made[x]), np.maximum(made[y], made[x])
            y = y[small >= like * large]
            if not len(y):
                continue
            mine = slice(starts[x], starts[x + 1])
            dense[kind[mine]] = times[mine]
            length = starts[y + 1] - starts[y]
            inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            place = np.repeat(starts[y], length) + inner
            both = np.add.reduceat(np.minimum(dense[kind[place]], times[place]), np.cumsum(length) - length)
            dense[kind[mine]] = 0
            near = y[both >= like * (made[x] + made[y] - both)]
            for other in near:
                if group[other] != group[x]:
                    links.append((x, other))
                    group[group == group[other]] = group[x]
        ids = pdf["id"].to_numpy()
        return pd.DataFrame([(max(ids[x], ids[y]), min(ids[x], ids[y])) for x, y in links], columns=["a", "b"], dtype="int64")

    return run


def _across(left: DataFrame, texts: DataFrame, like: float, shingle: int, block: int = BLOCK) -> DataFrame:
    dealt = _deal(left, block).join(texts, "id")
    return dealt.groupBy("key").applyInPandas(_compare(like, shingle), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, bands: int = BANDS, rows: int = ROWS, like: float = LIKE, shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, class_id, n_links, kept): one row per doc_id; a class is what links reach, named by its smallest id.

    Texts link when their five-word shingles, counted, have a Jaccard similarity of at least ``like``; a
    text of one to four words is one shingle. ``n_links`` counts the links found on the way, not all
    pairs of a class. Texts without words (null, empty, blank) link with nothing. Rows with a null
    doc_id are left out; rows that share a doc_id count as one document, with the smallest of their texts.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").filter("id is not null")
    drawn = materialise(sketches(known, bands, rows, shingle), "sketches")
    placed = drawn.select("id", F.explode("bands").alias("band")).distinct()
    sizes = placed.groupBy("band").agg(F.count("id").alias("size")).filter("size > 1")
    shared = materialise(placed.join(sizes, "band"), "shared")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    centres = (
        shared.join(weight, "id")
        .groupBy("band")
        .agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"))
    )
    texts = materialise(
        known.join(weight.select("id"), "id").groupBy("id").agg(F.min("text").alias("text")), "texts"
    )
    around = materialise(
        shared.select("band", "id").join(centres, "band"), "around"
    )
    star = around.filter("id <> centre").select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b"))
    links = materialise(_shared_text(star.distinct(), texts, like, shingle), "linked")
    first = materialise(components(links), "classes")
    member = around.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_bands = (
        member.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    )
    left = materialise(member.join(open_bands.select("band"), "band").select("band", "id", "component"), "left")
    late = materialise(_across(left, texts, like, shingle), "linked")
    every = links.union(late).distinct()
    classes = components(every)
    degree = every.select("a").union(every.select("b")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        drawn.select("id").distinct()
        .join(classes, "id", "left")
        .join(degree, "id", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.coalesce("component", "id").alias("class_id"),
            F.coalesce("n", F.lit(0)).alias("n_links"),
            (F.coalesce("component", "id") == F.col("id")).alias("kept"),
        )
    )
