"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles, or its phrases of some shingles. The Cartesian tree of a text's
token hashes has a node per token; the node at c spans the window [l, r] in which c holds the smallest hash,
so every passage from l..c to c..r has c's token as its min-hash. Only nodes of windows at least as long as
a stated width are built. Alike passages share a run of shingles of a known length, and so a phrase that is
the min-hash of half this run in both: their key. All members of a key are compared with its first one, by
their texts; then those that this left unsettled with the others, first by the shingles around them and what
passes by their texts, the nearest one before all. Diagonals are compared as bands, and the shared text decides.

Exact repeats do not depend on that pairing. Equal stretches of the shortest length have the same keys throughout, so
every stretch whose keys are all held by several documents is hashed as a whole and grouped by this hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm import hashing
from sessionloom.llm.components import components
from sessionloom.sources.scratch import materialise

SHINGLE = 5
WORDS = 50  # shortest passage
HASHES = 4
LIKE = 0.8
SIDE = 16  # places between c and the tokens that tell contexts apart
REACH = 8  # shortest passages that a diagonal is followed beyond its first and last meeting
TASKS = 8  # per core, of a verification: what pairs cost is not seen from their bytes
CELL = 512  # members of a key that one task compares with all others
_STRETCH = np.uint64(0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 26) - 1)
_LEAST_TASKS = "spark.sql.adaptive.coalescePartitions.minPartitionNum"
_LEAST_BYTES = "spark.sql.adaptive.coalescePartitions.minPartitionSize"


def _candidates(value: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the minimum of some run of ``width`` values of their text."""
    level, reach = value, 1
    while reach * 2 <= width:
        level = np.minimum(level[: len(level) - reach], level[reach:])
        reach *= 2
    if width > reach:
        level = np.minimum(level[: len(level) - (width - reach)], level[width - reach :])
    inside = np.zeros(len(value) + 1, bool)
    sizes = np.diff(starts)
    fit = np.maximum(0, sizes - width + 1)
    inside[np.repeat(starts[:-1], fit) + np.arange(int(fit.sum())) - np.repeat(np.cumsum(fit) - fit, fit)] = True
    return np.unique((level[inside[: len(level)]] & _PLACE).astype(np.int64))


def compact_windows(value: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes c of the texts' Cartesian trees with windows [l, r] of at least ``width`` places.

    ``value`` are hashes of all texts one after the other, ``starts`` where each text begins (and the end).
    Of equal hashes the earlier one counts as smaller.
    """
    if len(value) < width:
        return (np.zeros(0, np.int64),) * 3
    value = (value & ~_PLACE) | np.arange(len(value), dtype=np.uint64)
    at = _candidates(value, starts, width)
    text = np.searchsorted(starts, at, "right") - 1
    low, high = starts[text].tolist(), (starts[text + 1] - 1).tolist()
    v, places, owner = value[at].tolist(), at.tolist(), text.tolist()
    stack: list[int] = []
    for n in range(len(places)):  # the right spine of the tree built so far
        while stack and (owner[stack[-1]] != owner[n] or v[stack[-1]] > v[n]):
            top = stack.pop()
            if owner[top] == owner[n]:
                high[top] = places[n] - 1
        if stack:
            low[n] = places[stack[-1]] + 1
        stack.append(n)
    low, high = np.array(low, np.int64), np.array(high, np.int64)
    wide = high - low + 1 >= width
    return at[wide], low[wide], high[wide]


_WINDOWS = "key bigint, id bigint, c int, l int, r int, before bigint, after bigint"


def windows(docs: DataFrame, words: int = WORDS, hashes: int = HASHES, shingle: int = SHINGLE) -> DataFrame:
    """All compact windows of (id, text): min-hash key, place and extent in shingles, and context tokens."""
    width = words - shingle + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                token, made = hashing.shingles(*hashing.words(part.column("text")), shingle)
                starts = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                for n in range(hashes):
                    value = hashing.mix(token + np.uint64(n + 1) * np.uint64(0xA0761D65))
                    c, low, high = compact_windows(value, starts, width)
                    text = np.searchsorted(starts, c, "right") - 1
                    first = starts[text]
                    near = [
                        np.where(ok, np.maximum(token[np.where(ok, p, 0)], np.uint64(1)), np.uint64(0)).view(np.int64)  # 0 is none
                        for p, ok in ((c - SIDE, c - SIDE >= low), (c + SIDE, c + SIDE <= high))
                    ] if len(c) else [np.zeros(0, np.int64)] * 2
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(value[c].view(np.int64)), pa.array(ids[text].astype(np.int64)),
                            *[pa.array((x - first).astype(np.int32)) for x in (c, low, high)],
                            pa.array(near[0]), pa.array(near[1]),
                        ],
                        names=["key", "id", "c", "l", "r", "before", "after"],
                    )

    return docs.select("id", "text").mapInArrow(run, _WINDOWS)


def _stretch_hashes(token: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` tokens from each place on."""
    level, reach = token, 1
    while reach * 2 <= width:
        level = hashing.mix(level[: len(level) - reach] * _STRETCH + level[reach:])
        reach *= 2
    if width > reach:
        level = hashing.mix(level[: len(level) - (width - reach)] * _STRETCH + level[width - reach :])
    return level


def _exact(texts: DataFrame, words: int, like: float, shingle: int) -> DataFrame:
    """(id, first, end, other): stretches of at least ``words`` words that are the same in another document.

    In such a stretch every run of phrases that has a least one has it in both documents, so the places ``at`` where
    a text has a key of several documents follow each other closely. Every place of a text that can begin a stretch
    for it is grouped with all equal ones; ``other`` is the smallest other id.
    """
    width = words - shingle + 1
    long, apart = _phrase(words, like, shingle)
    inner = width - long + 1  # phrases of a stretch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                token, made = hashing.shingles(*hashing.words(part.column("text")), shingle)
                first = np.cumsum(made) - made
                if len(token) < width:
                    continue
                hashed = _stretch_hashes(token, width)
                text = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("at")).to_numpy())
                at = part.column("at").flatten().to_numpy().astype(np.int64)
                order = np.lexsort((at, text))
                text, at = text[order], at[order]
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(at, prepend=0) > apart))
                last = np.append(new[1:], len(at)) - 1
                text, low = text[new], np.maximum(0, at[new] - (apart - 1))
                size = np.maximum(0, np.minimum(at[last] - (inner - apart) + 1, made[text] - width + 1) - low)
                text = np.repeat(text, size)
                place = np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                ids = part.column("id").to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed[first[text] + place].view(np.int64)), pa.array(ids), pa.array(place.astype(np.int32))],
                    names=["stretch", "id", "p"],
                )

    same = Window.partitionBy("stretch")
    met = (
        texts.select("id", "at", "text").mapInArrow(run, "stretch bigint, id bigint, p int")
        .withColumn("lo", F.min("id").over(same))
        .withColumn("next", F.min(F.when(F.col("id") > F.col("lo"), F.col("id"))).over(same))
        .filter("next is not null")
        .select("id", "p", F.when(F.col("id") == F.col("lo"), F.col("next")).otherwise(F.col("lo")).alias("other"))
    )
    run_of = F.col("p") - F.row_number().over(Window.partitionBy("id", "other").orderBy("p"))
    return (
        met.withColumn("run", run_of)
        .groupBy("id", "other", "run")
        .agg(F.min("p").cast("bigint").alias("first"), (F.max("p") + words).cast("bigint").alias("end"))
        .select("id", "first", "end", "other")
    )


def _segments(same: np.ndarray, width: int, share: float) -> Iterator[tuple[int, int]]:
    """Separate stretches of at least ``width`` places of which at least ``share`` are shared.

    The longest such stretch is taken first, so runs that are too short alone are joined while their union
    still holds enough. Places at its ends that are not shared go, down to the least length.
    """
    todo = [(0, len(same))]
    while todo:
        a, b = todo.pop()
        if b - a < width:
            continue
        shared = np.count_nonzero(same[a:b])
        if shared == b - a:
            yield a, b
            continue
        if shared < share * width - 1e-6:
            continue
        sums = np.concatenate([[0.0], np.cumsum(np.where(same[a:b], 1.0 - share, -share))])
        lowest = np.minimum.accumulate(sums)
        first = np.searchsorted(-lowest, -sums - 1e-9)  # the earliest start from which the sum is not negative
        length = np.arange(len(sums)) - first
        end = int(length.argmax())
        if length[end] < width:
            continue
        start = int(first[end])
        while end - start > width and not same[a + start]:
            start += 1
        while end - start > width and not same[a + end - 1]:
            end -= 1
        yield a + start, a + end
        todo += [(a, a + start), (a + end, b)]


def _dense(same: np.ndarray, width: int, share: float) -> bool:
    """Whether some stretch of at least ``width`` places has a ``share`` of them shared."""
    if len(same) < width:
        return False
    sums = np.concatenate([[0.0], np.cumsum(same - share)])
    return bool((sums[width:] + 1e-9 >= np.minimum.accumulate(sums[: len(sums) - width])).any())


def _codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The tokens of two texts as small numbers, and how many numbers there are."""
    known, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    code = code.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    return code[: len(a)], code[len(a) :], len(known)


def _shared_passages(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int]], width: int, like: float):
    """Passages of a that occur in b near a diagonal: (first, end, first in b, end in b), in shingles.

    Of places that are equal on the diagonal a share of 2 like / (1 + like) makes two stretches of one length
    alike, so those need no other test. What they leave is searched for words put in or left out. Where a word
    or a line is repeated, many diagonals put equal stretches side by side; these are compared once.
    """
    share = 2 * like / (1 + like)
    least = share * width
    a, b, size = _codes(a, b)
    in_b = _found(a, b, size)
    if not _dense(in_b, width, like):
        return
    in_a = _found(b, a, size)
    gaps, seen_a, seen_b = [], np.zeros(len(a), bool), np.zeros(len(b), bool)

    def cover(passages):
        for s, e, x, y in passages:
            seen_a[s:e], seen_b[x:y] = True, True
        return passages

    for d, lo, hi in parts:
        lo, hi = max(0, lo, d), min(len(a), hi + 1, len(b) + d)
        if hi - lo < width:
            continue
        equal = a[lo:hi] == b[lo - d : hi - d]
        many = np.count_nonzero(equal)
        straight = [(0, hi - lo)] if many == hi - lo else sorted(_segments(equal, width, share)) if many >= least else []
        yield from cover([(lo + s, lo + e, lo + s - d, lo + e - d) for s, e in straight])
        edges = [0, *(x for span in straight for x in span), hi - lo]
        gaps += [(d, lo + s, lo + e) for s, e in zip(edges[::2], edges[1::2]) if e - s >= width]
    looked, looks = np.zeros((3, len(gaps)), np.int64), 0
    known: dict[tuple[bytes, bytes], list[tuple[int, int, int, int]]] = {}
    mates: dict[tuple[bytes, bytes], tuple[int, int] | None] = {}
    for d, lo, hi in gaps:
        # a look at a wider gap on a diagonal close by had all of this one's places
        e, x, y = looked[:, :looks]
        if ((x <= lo) & (hi <= y) & (np.abs(d - e) <= (y - x) // 8)).any():
            continue
        mine, other = in_b[lo:hi], slice(lo - d, hi - d)
        # the shared places of most gaps are known from other diagonals
        if np.count_nonzero(mine) >= least and not (seen_a[lo:hi][mine].all() and seen_b[other][in_a[other]].all()):
            slack = (hi - lo) // 4
            at = max(0, lo - d - slack)
            near = b[at : hi - d + slack]
            sides = a[lo:hi].tobytes(), near.tobytes()
            if sides not in known:
                known[sides] = list(_shifted(a[lo:hi], near, size, width, like, mates))
            yield from cover([(lo + s, lo + e, at + x, at + y) for s, e, x, y in known[sides]])
            looked[:, looks] = d, lo, hi
            looks += 1


def _found(mine: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """Which codes of ``mine`` occur in ``other``."""
    there = np.zeros(size, bool)
    there[other] = True
    return there[mine]


def _shifted(mine: np.ndarray, other: np.ndarray, size: int, width: int, like: float, mates: dict):
    """Passages of ``mine`` that are alike to a stretch of ``other``; ``mates`` keeps what is known of such passages."""
    same = _found(mine, other, size)
    shares = [2 * like / (1 + like), 0.95, 0.999]  # of shared tokens; the stricter ones on what the others reject
    todo, text = [(0, len(mine), 0)], other.tobytes()
    while todo:
        x, y, strict = todo.pop()
        for s, e in _segments(same[x:y], width, shares[strict]):
            s, e = s + x, e + x
            passage = mine[s:e].tobytes(), text
            if passage not in mates:
                mates[passage] = _mate(mine[s:e], other, size, width, like)
            mate = mates[passage]
            if mate:
                yield s, e, *mate
            elif strict + 1 < len(shares):
                todo.append((s, e, strict + 1))


def _mate(mine: np.ndarray, other: np.ndarray, size: int, width: int, like: float) -> tuple[int, int] | None:
    """A stretch of ``other`` that is alike to a passage."""
    there = _found(other, mine, size)
    near = np.flatnonzero(there)
    if len(near) < like * len(mine) - 1e-6:
        return None
    counts = np.bincount(mine, minlength=size)
    for x, y in [*_segments(there, int(like * width), 2 * like / (1 + like)), (int(near[0]), int(near[-1]) + 1)]:
        if _alike(counts, len(mine), other[x:y]) >= like:
            return x, y
    return None


def _alike(counts: np.ndarray, total: int, b: np.ndarray) -> float:
    """Jaccard similarity of counted tokens: of ``total`` ones by their counts, and of the codes b."""
    both = int(np.minimum(counts, np.bincount(b, minlength=len(counts))).sum())
    return both / (total + len(b) - both)


def _union(spans: list[tuple[int, int]], shingle: int) -> list[tuple[int, int]]:
    """Spans in shingles, those whose words overlap joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1] + shingle - 1:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _verify(pairs: DataFrame, texts: DataFrame, words: int, like: float, shingle: int) -> DataFrame:
    width = words - shingle + 1
    one = texts.select("id", F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("rep"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch, "text_a", "text_b"):
                sides = []
                for side in ("text_a", "text_b"):
                    column = part.column(side).dictionary_encode()  # a text that stands in many pairs is hashed once
                    token, made = hashing.shingles(*hashing.words(column.dictionary), shingle)
                    own = np.split(token, np.cumsum(made)[:-1])
                    sides.append([own[n] for n in column.indices.to_pylist()])
                rows = []
                parts = part.column("parts")
                cuts = np.cumsum(pc.list_value_length(parts).to_numpy())[:-1]
                fields = (parts.flatten().field(n).to_numpy().astype(np.int64) for n in range(4))  # d, n, lo, hi
                runs = zip(*(np.split(f, cuts) for f in fields), strict=True)
                facts = (part.column(c).to_pylist() for c in ("id", "rep"))
                for a, b, doc, rep, run_of in zip(*sides, *facts, runs, strict=True):
                    spans = _diagonals(*run_of)
                    found = list(_shared_passages(a, b, spans, width, like))
                    rows += [(doc, s, e + shingle - 1, rep) for s, e in _union([f[:2] for f in found], shingle)]
                    rows += [(rep, x, y + shingle - 1, doc) for x, y in _union([f[2:] for f in found], shingle)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(v) for v in c], pa.int64()) for c in columns], names=["id", "first", "end", "other"]
                )

    return (
        pairs.join(one, "id").join(two, "rep").select("id", "rep", "parts", "text_a", "text_b")
        .mapInArrow(run, "id bigint, first bigint, end bigint, other bigint")
    )


def _run(words: int, like: float, shingle: int) -> int:
    """Shingles in a row that two alike stretches share at least, the longer one of ``words`` words or more.

    A change within them breaks at least shingle - 1 shingles on either side, so the number of changes
    between n and m shingles is bounded by what likeness allows to be unshared.
    """
    share = like / (1 + like)
    width, run = words - shingle + 1, words
    for changes in range(width):
        unshared = 2 * changes * (shingle - 1)
        both = max(unshared / (1 - 2 * share) if share < 0.5 else 0, width * (1 + like))
        run = min(run, math.ceil(math.ceil(share * both - 1e-9) / (changes + 1)))
    return max(2, run)


def _phrase(words: int, like: float, shingle: int) -> tuple[int, int]:
    """Shingles of a phrase, and phrases in a row of which one is a key."""
    run = _run(words, like, shingle)
    return (run + 1) // 2, run - (run + 1) // 2 + 1


def phrases(docs: DataFrame, words: int = WORDS, like: float = LIKE, shingle: int = SHINGLE) -> DataFrame:
    """(key, id, c): compact windows over phrases, the runs of half as many shingles as alike texts share in a row.

    A window is as long as the other half, so of every run that two texts share, one phrase has the smallest
    hash in both: no pair of alike passages is without a common key. One hash function is enough.
    """
    long, width = _phrase(words, like, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                token, made = hashing.shingles(*hashing.words(part.column("text")), shingle)
                if len(token) < long:
                    continue
                fit = np.maximum(0, made - long + 1)
                starts = np.concatenate([[0], np.cumsum(fit)]).astype(np.int64)
                place = np.arange(int(starts[-1])) + np.repeat(np.cumsum(made) - made - starts[:-1], fit)
                value = _stretch_hashes(token, long)[place]
                c, _, _ = compact_windows(value, starts, width)
                text = np.searchsorted(starts, c, "right") - 1
                ids = part.column("id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[c].view(np.int64)), pa.array(ids[text].astype(np.int64)), pa.array((c - starts[text]).astype(np.int32))],
                    names=["key", "id", "c"],
                )

    return docs.select("id", "text").mapInArrow(run, "key bigint, id bigint, c int")


def _bands(meetings: DataFrame, width: int, label: str = "pairs") -> DataFrame:
    """(id, rep, parts): the diagonals of each pair, each from before its first meeting to behind its last one.

    A meeting of n places in a row with one place is n diagonals from d up, each a place further on; one of a place
    with -n in a row is -n diagonals from d down. Only ``_diagonals`` lays them out.
    """
    runs = meetings.groupBy("id", "rep", "d", "n").agg(
        (F.min("c") - REACH * width).alias("lo"), (F.max("c") + (REACH + 1) * width).alias("hi")
    )
    return materialise(runs.groupBy("id", "rep").agg(F.collect_list(F.struct("d", "n", "lo", "hi")).alias("parts")), label)


def _diagonals(d: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int]]:
    """The single diagonals of a pair's runs (see ``_bands``), ascending, each with its first and last place."""
    size = np.abs(n)
    run = np.repeat(np.arange(len(d)), size)
    step = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    ahead = np.where(n[run] > 0, step, 0)
    each, at = np.unique(d[run] + np.sign(n[run]) * step, return_inverse=True)
    first, last = np.full(len(each), np.iinfo(np.int64).max), np.full(len(each), np.iinfo(np.int64).min)
    np.minimum.at(first, at, lo[run] + ahead)
    np.maximum.at(last, at, hi[run] + ahead)
    return list(zip(each.tolist(), first.tolist(), last.tolist(), strict=True))


def _merged(both: DataFrame) -> DataFrame:
    """(id, first_word, end_word, similar_to): overlapping findings of a document as one passage."""
    spans = both.groupBy("id", "first", "end").agg(F.min("other").alias("other"))
    order = Window.partitionBy("id").orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.coalesce((F.col("first") >= reach).cast("int"), F.lit(1)))
    numbered = opened.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "passage").agg(
        F.min("first").alias("first_word"), F.max("end").alias("end_word"), F.min("other").alias("similar_to")
    )


def _classes(both: DataFrame) -> DataFrame:
    return components(both.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct())


def _chains(text: np.ndarray, key: np.ndarray, c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text and key at even distances of ``most`` or less as one: order, where each begins, length, distance."""
    order = np.lexsort((c, key, text))
    text, key, c = text[order], key[order], c[order]
    gap = np.diff(c, prepend=0)
    joined = np.zeros(len(c), bool)
    joined[1:] = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (gap[1:] <= most) & (gap[1:] > 0)
    begins = ~joined
    begins[2:] |= joined[1:-1] & (gap[2:] != gap[1:-1])
    new = np.flatnonzero(begins)
    size = np.diff(np.append(new, len(c)))
    return order, new, size, np.where(size > 1, gap[np.minimum(new + 1, max(0, len(c) - 1))], 1)


_MEMBERS = (
    "id bigint, class bigint, key bigint, covered boolean, plain boolean, at array<struct<c: int, n: int, step: int>>, what binary, base binary"
)


def _surroundings(places: DataFrame, words: int, like: float, shingle: int) -> DataFrame:
    """The shingles around each place, as numbers of 16 bits; ``plain`` says that none of them is there twice.

    In ``what`` a shingle has another number each time; ``base`` has those of rows that are not plain without that.

    Places of a key that follow each other at even distances, as in a word said over and over, are one (first place,
    number, distance) with the surroundings of all; those of a text with equal surroundings are one row.
    """
    width = words - shingle + 1
    long, _ = _phrase(words, like, shingle)
    side = width - long
    most = width + side  # places around one place; no shingle is there more often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                token, made = hashing.shingles(*hashing.words(part.column("text")), shingle)
                first = np.cumsum(made) - made
                text = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("at")).to_numpy())
                at = part.column("at").flatten()
                key, c, covered = (at.field(n).to_numpy(zero_copy_only=False) for n in ("key", "c", "covered"))
                inside = np.flatnonzero(c + long <= made[text])  # windows of other texts of the id may lie beyond
                if not len(inside):
                    continue
                text, key, c, covered = text[inside], key[inside], c[inside].astype(np.int64), covered[inside]
                order, new, count, step = _chains(text, key, c, long)
                text, key, c = text[order][new], key[order][new], c[order][new]
                covered = np.minimum.reduceat(covered[order].astype(np.int8), new).astype(bool)
                low, high = np.maximum(0, c - side), np.minimum(made[text], c + (count - 1) * step + long + side)
                for some in _portions(text, high - low):
                    t, size = text[some], (high - low)[some]
                    row, shift = np.repeat(np.arange(len(some)), size), np.cumsum(size) - size
                    near = np.arange(len(row)) - np.repeat(shift - low[some], size)
                    what = token[first[t][row] + near]
                    again = np.minimum(hashing.occurrences(what, row), most)
                    around = np.add.reduceat(hashing.mix(what ^ hashing.mix((near - c[some][row]).astype(np.uint64))), shift)
                    base = (hashing.mix(what) >> np.uint64(48)).astype(np.uint16)
                    what = (hashing.mix(what + again.astype(np.uint64) * _STRETCH) >> np.uint64(48)).astype(np.uint16)
                    plain = (count[some] == 1) & (np.maximum.reduceat(again, shift) == 0)
                    same = np.lexsort((c[some], around, key[some], t))
                    head = np.ones(len(same), bool)
                    head[1:] = (np.diff(t[same]) != 0) | (np.diff(key[some][same]) != 0) | (np.diff(around[same]) != 0)
                    head = np.flatnonzero(head)
                    one = some[same[head]]
                    at = pa.StructArray.from_arrays(
                        [pa.array(x[some][same].astype(np.int32)) for x in (c, count, step)], names=["c", "n", "step"]
                    )
                    sets, bases = np.split(what, shift[1:]), np.split(base, shift[1:])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[part.column(n).take(pa.array(text[one])) for n in ("id", "class")], pa.array(key[one]),
                            pa.array(np.minimum.reduceat(covered[some][same].astype(np.int8), head).astype(bool)), pa.array(plain[same[head]]),
                            pa.ListArray.from_arrays(pa.array(np.append(head, len(same)).astype(np.int32)), at),
                            pa.array([sets[n].tobytes() for n in same[head]], pa.binary()),
                            pa.array([b"" if plain[n] else bases[n].tobytes() for n in same[head]], pa.binary()),
                        ],
                        names=["id", "class", "key", "covered", "plain", "at", "what", "base"],
                    )

    return places.mapInArrow(run, _MEMBERS)


def _portions(text: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Rows in order, cut where a text begins (or within a long one) after about a million of their ``size``."""
    behind = np.cumsum(size) - size
    begins = np.flatnonzero(np.diff(text, prepend=-1))
    start = np.repeat(behind[begins], np.diff(np.append(begins, len(text))))
    cut = (np.diff(start // 1_000_000) != 0) | ((np.diff((behind - start) // 4_000_000) != 0) & (np.diff(text) == 0))
    return np.split(np.arange(len(text)), np.flatnonzero(cut) + 1)


def _met_places(pairs: DataFrame) -> DataFrame:
    """(id, rep, d, n, c) of pairs of rows with places x and y: as in ``_bands``."""
    up = """if(r.step = 1, array(struct(r.c - e.c as d, r.n as n, r.c as c)),
               transform(sequence(0, r.n - 1), i -> struct(r.c + i * r.step - e.c as d, 1 as n, r.c + i * r.step as c)))"""
    down = """if(e.n = 1, cast(array() as array<struct<d: int, n: int, c: int>>), if(e.step = 1, array(struct(r.c - e.c as d, -e.n as n, r.c as c)),
               transform(sequence(1, e.n - 1), i -> struct(r.c - e.c - i * e.step as d, 1 as n, r.c as c))))"""
    both = f"concat({up}, {down})"
    mine = f"flatten(transform(x, r -> element_at(transform(slice(y, 1, 1), e -> {both}), 1)))"
    others = f"flatten(transform(slice(y, 2, size(y)), e -> element_at(transform(slice(x, 1, 1), r -> {both}), 1)))"
    return pairs.select("id", "rep", F.explode(F.expr(f"concat({mine}, {others})")).alias("met")).select("id", "rep", "met.*")


def _covered(rows: DataFrame, found: DataFrame, long: int, shingle: int) -> DataFrame:
    """Rows (id, c) with the class of their document, and whether place c lies in a passage found."""
    spans = _merged(found).groupBy("id").agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans"))
    inside = F.exists("spans", lambda x: (x["first_word"] <= F.col("c")) & (F.col("c") + (long + shingle - 1) <= x["end_word"]))
    classes = _classes(found).select("id", F.col("component").alias("class"))
    known = classes.join(spans, "id")
    return rows.join(known, "id", "left").withColumns({"class": F.coalesce("class", "id"), "covered": F.coalesce(inside, F.lit(False))}).drop("spans")


def _members(met: DataFrame, found: DataFrame, texts: DataFrame, words: int, like: float, shingle: int) -> DataFrame:
    """Members of the keys that the comparison with the first one left unsettled, with their surroundings and class.

    Two members that lie in passages of one class are settled: they are linked already.
    """
    long, _ = _phrase(words, like, shingle)
    group = Window.partitionBy("key")
    members = (
        _covered(met.filter("n > 2 and not (id = rep and c = at)").select("key", "id", "c"), found, long, shingle)
        .withColumns({"some": F.min("covered").over(group), "lo": F.min("class").over(group), "hi": F.max("class").over(group),
                      "low": F.min("id").over(group), "high": F.max("id").over(group)})
        .filter("low < high and (lo < hi or not some)")
    )
    places = members.groupBy("id", "class").agg(F.collect_list(F.struct("key", "c", "covered")).alias("at"))
    return materialise(
        _surroundings(places.join(texts.select("id", "text"), "id").select("id", "class", "at", "text"), words, like, shingle), "members"
    )


def _again(rows: DataFrame, found: DataFrame, words: int, like: float, shingle: int) -> DataFrame:
    """The members with their classes and whether they lie in passages, as far as these are found now."""
    long, _ = _phrase(words, like, shingle)
    spans = _merged(found).groupBy("id").agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans"))
    classes = _classes(found).select("id", F.col("component").alias("class"))
    inside = F.expr(
        f"""coalesce(forall(at, r -> exists(spans, s -> s.first_word <= r.c
            and r.c + (r.n - 1) * r.step + {long + shingle - 1} <= s.end_word)), false)"""
    )
    return materialise(
        rows.drop("class").join(classes.join(spans, "id"), "id", "left")
        .withColumns({"covered": F.col("covered") | inside, "class": F.coalesce("class", "id")}).drop("spans"),
        "again",
    )


def _unmet(rows: DataFrame, words: int, like: float, shingle: int, best: bool = False) -> DataFrame:
    """(id, rep, d, n, c): meetings of a key's members with each other that are not settled yet.

    Members outside of passages, and those in passages of another class than most of their key, are held against all
    others: of the shingles around the one, ``words`` words of them in a row, so many must stand around the other as
    likeness asks for. With ``best``, only the one that shares most goes on; what it settles need not be compared with
    the others. Members of a large key are dealt to cells.
    """
    width = words - shingle + 1
    long, _ = _phrase(words, like, shingle)
    many = rows.groupBy("key", "class").agg(F.count("id").alias("n"), F.min("covered").alias("all"))
    keys = many.groupBy("key").agg(
        F.max_by("class", F.struct("n", "class")).alias("most"), F.sum("n").alias("n"), F.count("n").alias("classes"), F.min("all").alias("all")
    ).filter("classes > 1 or not all")
    open_rows = rows.join(keys.select("key", "most", (1 + F.expr(f"n div {CELL}")).alias("down"), (1 + F.expr(f"n div {32 * CELL}")).alias("along")), "key")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id", "at"), F.col(n))
    open_rows = open_rows.withColumn("asks", F.expr("not covered or class <> most"))
    left = open_rows.filter("asks").withColumn("i", deal("down")).withColumn("j", to("along")).withColumn("side", F.lit(0))
    right = open_rows.withColumn("j", deal("along")).withColumn("i", to("down")).withColumn("side", F.lit(1))
    columns = ["key", "i", "j", "side", "asks", "id", "class", "covered", "plain", "at", "what", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_none(batches):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None or not held.num_rows:
                continue
            cell = np.stack([held.column(n).to_numpy() for n in ("key", "i", "j")])
            begins = np.flatnonzero(np.append(True, (np.diff(cell) != 0).any(axis=0)))
            whole = held.num_rows if batch is None else int(begins[-1])
            if not whole:
                continue
            done, held = held.slice(0, whole).combine_chunks(), held.slice(whole)
            begins = begins[begins < whole]
            yield from _alike_places(done, begins, long, width, like, best)

    schema = "id bigint, rep bigint, x array<struct<c: int, n: int, step: int>>, y array<struct<c: int, n: int, step: int>>"
    dealt = left.select(*columns).union(right.select(*columns)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return _met_places(dealt.mapInArrow(run, schema))


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _near_enough(one: np.ndarray, others: np.ndarray, known: tuple[np.ndarray, np.ndarray], larger: np.ndarray, long: int, width: int, like: float) -> np.ndarray:
    """Which of the others have stretches of ``width`` shingles or more around their places that may be alike to one's.

    Each side is a row of shingles with the phrase in its middle; ``known`` tells which of them are there. Of two
    stretches at most those shingles are shared that occur anywhere around the other place. ``larger`` says whose id
    is the larger one: its stretch has the full length and, as ``_shared_passages`` wants, the share of two alike ones.
    """
    span, out = len(one), np.zeros(len(others), bool)
    side = (span - long) // 2
    sizes = np.arange(int(like * width), span + 1)
    total = sizes[:, None] + sizes
    for a in range(0, len(others), 64):
        equal = (one[None, :, None] == others[a : a + 64, None, :]) & known[0][None, :, None] & known[1][a : a + 64, None, :]
        most = []
        for shared in (equal.any(axis=2), equal.any(axis=1)):
            sums = np.zeros((len(shared), span + 1), np.int16)
            np.cumsum(shared, axis=1, out=sums[:, 1:])
            starts = [slice(max(0, side + long - n), min(side, span - n) + 1) for n in sizes.tolist()]
            most.append(np.stack([(sums[:, x.start + n : x.stop + n] - sums[:, x]).max(axis=1) for x, n in zip(starts, sizes.tolist(), strict=True)], axis=1))
        given = np.where(larger[a : a + 64, None], most[1], most[0])
        given = (given >= 2 * like / (1 + like) * sizes - 1e-6) & (sizes >= width)
        some = np.flatnonzero(given.any(axis=1))
        both = np.minimum(most[0][some, :, None], most[1][some, None, :])
        sided = np.where(larger[a + some, None, None], given[some, None, :], given[some, :, None])
        out[a + some] = ((both >= like * (total - both) - 1e-6) & sided).any(axis=(1, 2))
    return out


def _alike_places(rows: pa.Table, begins: np.ndarray, long: int, width: int, like: float, best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one cell, of each that asks with those that may be alike around their places."""
    least, span = math.ceil(like * width - 1e-6), 2 * width - long
    fewest = int(0.9 * like * width)  # where shingles repeat, only counts of all of them are compared
    asked, asks, covered, plain = (rows.column(n).to_numpy().astype(bool) for n in ("side", "asks", "covered", "plain"))
    ids, classes = (rows.column(n).to_numpy() for n in ("id", "class"))
    what, base = ([np.frombuffer(b, np.uint16) for b in rows.column(n).to_pylist()] for n in ("what", "base"))
    at = rows.column("at").combine_chunks()
    lead = np.maximum(0, (span - long) // 2 - at.values.field("c").to_numpy()[at.offsets.to_numpy()[:-1]])

    def laid(some):
        out, known = np.zeros((len(some), span), np.uint16), np.zeros((len(some), span), bool)
        for k, n in enumerate(some):
            out[k, lead[n] : lead[n] + len(what[n])], known[k, lead[n] : lead[n] + len(what[n])] = what[n], True
        return out, known

    def shared(mine, other):
        there[other] = True
        out = there[mine]
        there[other] = False
        return out

    def dense(n, m):
        """Whether shingles of a row with repeats, and of the other one, lie as close as ``_near_enough`` wants."""
        n, m = (n, m) if ids[n] > ids[m] else (m, n)
        mine, other = (base[x] if len(base[x]) else what[x] for x in (n, m))
        less = np.pad(shared(other, mine), width - int(like * width))
        return _dense(shared(mine, other), width, 2 * like / (1 + like)) and _dense(less, width, like)

    ends = np.append(begins[1:], rows.num_rows)
    there, pairs = np.zeros(1 << 16, bool), []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        left, right = a + np.flatnonzero(~asked[a:b]), a + np.flatnonzero(asked[a:b])
        if not len(left) or not len(right):
            continue
        once = plain[right]
        table, known = laid(right[once].tolist())
        many = [what[n] for n in right[~once]]
        flat, begin = np.concatenate([*many, np.zeros(1, np.uint16)]), np.cumsum([0, *map(len, many)])[:-1]
        for n in left.tolist():
            # of two that ask, the one with the larger id does
            open_ = (ids[right] != ids[n]) & ~((classes[right] == classes[n]) & covered[right] & covered[n]) & ((ids[right] < ids[n]) | ~asks[right])
            if not open_.any():
                continue
            there[what[n]] = True
            near = there[table] & known
            common = np.zeros(len(right), np.int64)
            common[once] = np.count_nonzero(near, axis=1)
            if len(many):
                common[~once] = np.add.reduceat(there[flat], begin, dtype=np.int64)
            there[what[n]] = False
            open_ &= common >= np.where(once & plain[n], least, fewest)
            if not open_.any():
                continue
            mates = np.flatnonzero(open_)
            closely = mates[once[mates]] if plain[n] else mates[:0]
            if len(closely):
                at_table = np.cumsum(once)[closely] - 1
                sums = np.zeros((len(closely), span + 1), np.int16)
                np.cumsum(near[at_table], axis=1, out=sums[:, 1:])
                common[closely] = (sums[:, width:] - sums[:, :-width]).max(axis=1)
                some = common[closely] >= least
                closely, at_table = closely[some], at_table[some]
                mine, mine_known = laid([n])
                fit = _near_enough(mine[0], table[at_table], (mine_known[0], known[at_table]), ids[right[closely]] > ids[n], long, width, like)
                mates = np.append(mates[~once[mates]], closely[fit])
            good = mates[[bool(once[m] and plain[n]) or (common[m] >= least and dense(n, right[m])) for m in mates.tolist()]] if len(mates) else mates
            if len(good) or not best:
                mates = good
            if best and len(mates):
                mates = mates[[np.lexsort((ids[right][mates], ~covered[right][mates], -common[mates]))[0]]]
            pairs += [(n, m) for m in right[mates].tolist()]
        if len(pairs) > 100_000 or b == rows.num_rows and pairs:
            x, y = np.array(pairs).T
            pairs = []
            swap = ids[x] < ids[y]
            x, y = pa.array(np.where(swap, y, x)), pa.array(np.where(swap, x, y))
            columns = [rows.column(c).take(n).combine_chunks() for c, n in (("id", x), ("id", y), ("at", x), ("at", y))]
            for cut in range(0, len(x), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(cut, 20_000) for c in columns], names=["id", "rep", "x", "y"])


@contextmanager
def _many_tasks(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution puts small partitions together by their bytes; here it leaves TASKS of them a core."""
    before = {name: spark.conf.get(name, None) for name in (_LEAST_TASKS, _LEAST_BYTES)}
    spark.conf.set(_LEAST_TASKS, str(TASKS * spark.sparkContext.defaultParallelism))
    spark.conf.set(_LEAST_BYTES, "64k")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def repeated_passages(docs: DataFrame, words: int = WORDS, like: float = LIKE, shingle: int = SHINGLE) -> DataFrame:
    """Passages of at least ``words`` words that occur again in another document, one row per passage.

    Every passage repeated word by word is found. Alike passages share a run of words that gives them a common key,
    and every meeting under a key is compared or known to lie in passages of one class.
    Returns doc_id, first_word and end_word (counted from 0, end exclusive; overlapping findings of a document
    are one passage), similar_to (the smallest document found to share it) and class_id (the smallest doc_id
    that shared passages reach). Likeness is the Jaccard similarity of counted five-word shingles. Repeats
    within one document do not count. Null and short texts have none; rows without a doc_id are left out; rows
    that share a doc_id count as one document, with the smallest of their texts.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text")).filter(
        "id is not null"
    )
    width = words - shingle + 1
    group = Window.partitionBy("key")
    met = materialise(
        phrases(known, words, like, shingle)
        .withColumns({"first": F.min(F.struct("id", "c")).over(group), "hi": F.max("id").over(group), "n": F.count("id").over(group)})
        .filter("first.id < hi")
        .select("key", "id", "c", F.col("first.id").alias("rep"), F.col("first.c").alias("at"), "n"),
        "met",
    )
    stars = _bands(met.filter("id <> rep").select("id", "rep", (F.col("c") - F.col("at")).alias("d"), F.lit(1).alias("n"), "c"), width)
    places = met.groupBy("id").agg(F.collect_list("c").alias("at"))
    texts = materialise(known.join(places, "id").groupBy("id").agg(F.min("text").alias("text"), F.first("at").alias("at")), "texts")
    with _many_tasks(docs.sparkSession):
        stars = materialise(_verify(stars, texts, words, like, shingle), "stars")
    found = materialise(stars.union(_exact(texts, words, like, shingle)), "found")
    rows = _members(met, found, texts, words, like, shingle)
    near = _bands(_unmet(rows, words, like, shingle, best=True), width)
    with _many_tasks(docs.sparkSession):
        near = materialise(_verify(near, texts, words, like, shingle), "near")
    found = found.union(near)
    rest = _bands(_unmet(_again(rows, found, words, like, shingle), words, like, shingle), width, "left")
    with _many_tasks(docs.sparkSession):
        rest = materialise(_verify(rest, texts, words, like, shingle), "rest")
    both = found.union(rest)
    merged = _merged(both)
    return merged.join(_classes(both), "id").select(
        F.col("id").alias("doc_id"), "first_word", "end_word", "similar_to", F.col("component").alias("class_id")
    )
