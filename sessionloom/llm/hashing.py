"""Vectorised word and shingle hashes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21  # text handled at once; a longer text is a slice of its own
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def slices(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole texts (of the column ``text``, or the named ones) of about SLICE_BYTES."""
    sizes = sum(
        pc.binary_length(batch.column(batch.schema.get_field_index(c))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in columns or ("text",)
    )
    group = np.cumsum(sizes) // SLICE_BYTES
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        yield batch.slice(rows[0], len(rows))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by a space, and where each text starts (and the end)."""
    parts = [v if v is not None else b"" for v in column.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return data, starts


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of bytes that end with white space."""
    inside = ~_WHITE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word: a polynomial over its bytes, scrambled."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = end - first
    shift = np.cumsum(size) - size
    inside = np.arange(int(size.sum()), dtype=np.int64)
    place = inside - np.repeat(shift, size)
    power = np.cumprod(np.full(int(size.max()) + 1, _STEP, np.uint64))
    value = _BYTE[data[place + np.repeat(first, size)]] * power[place]
    return mix(np.add.reduceat(value, shift) + power[size])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of words of each text."""
    data, starts = text_bytes(column)
    first, end = word_bounds(data)
    counts = np.diff(np.searchsorted(first, starts))
    return word_hashes(data, first, end), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words and their number per text; a text of 1 to n-1 words has one run."""
    counts = np.asarray(counts, np.int64)
    starts = np.cumsum(counts) - counts
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), made)
    at = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made) + starts[text]
    length = np.minimum(counts[text], n)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        here = length > k
        out[here] = mix(out[here] * _STEP + hashes[at[here] + k] + np.uint64(k + 1))
    return out, made


def occurrences(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many equal keys of the same group come before each."""
    order = np.lexsort((keys, group))
    k, g = keys[order], group[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out
