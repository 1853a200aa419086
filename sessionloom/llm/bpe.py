"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one gadget per merge and in merge order, into a deterministic automaton whose
arcs carry tokens and whose paths are exactly the tokenizations that applying the merges would give. A
state is the automaton after one token. The gadget of merge ``u v -> w`` copies the state behind ``u``
without its ``v`` arc, and gives every state that can go ``u v`` an arc ``w`` to the state behind ``v``.
A state therefore is its list of removed arcs with their times: the removals made on ``u`` itself plus,
for a merged token, what the state behind its right part had lost when the token was made.

Every string has one path, so a word is encoded by walking arcs whose labels spell it, and token ids are
decoded by emitting arc labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_END = "</w>"
MAX_WORDS = 400_000  # words kept per Python worker; beyond it the table starts afresh
MAX_ARCS = 1_000_000  # transitions kept per Python worker
# Fixed: white space as Unicode defines it, and the pre-split of the vocabulary file.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_NOT_WHITE = "\x1c\x1d\x1e\x1f"  # white space for str.split, but not for Unicode


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbol = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in symbol)
    symbol.update({b: chr(256 + n) for n, b in enumerate(hidden)})
    return [symbol[b] for b in range(256)]


@lru_cache(maxsize=4)
def _ranges(major: str) -> str:
    """The code points of a general category, as the inside of a character class."""
    member = regex.compile(rf"\p{{{major}}}").match
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and member(chr(c)) is not None
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


class Automaton:
    """States are token ids, plus START; an arc from a state carries the next token's id."""

    START = -1

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        size = max(vocab.values(), default=-1) + 1
        self.label = [""] * size
        for text, i in vocab.items():
            self.label[i] = text
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.made = [-1] * size
        self.removed: list[dict[int, int]] = [{} for _ in range(size)]
        self.gone: set[int] = set()
        self.arcs: dict[int, bool] = {}
        self.size = size
        for time, (u, v) in enumerate(merges):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
        self.longest = max((len(t) for t in vocab), default=1)

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if self.parts[w] is not None:
            raise ValueError(f"two merges make {self.label[w]!r}")
        if self._follows(u, v):
            self.removed[u][v] = time
        else:  # no path goes u v any more, so no arc carries w
            self.gone.add(w)
        self.parts[w] = (u, v)
        self.made[w] = time

    def _lost(self, state: int, token: int) -> int | None:
        """When the state lost its arc for the token: on the state itself, or before it was copied."""
        limit = None
        while True:
            time = self.removed[state].get(token)
            if time is not None and (limit is None or time < limit):
                return time
            if self.parts[state] is None:
                return None
            made = self.made[state]
            limit = made if limit is None else min(limit, made)
            state = self.parts[state][1]

    def _follows(self, state: int, token: int) -> bool:
        """An arc for a merged token was added only where its left part's arc still existed."""
        if token in self.gone or state in self.gone:
            return False
        until = None
        while True:
            time = self._lost(state, token)
            if time is not None and (until is None or time <= until):
                return False
            if self.parts[token] is None:
                return True
            made = self.made[token]
            until = made if until is None else min(until, made)
            token = self.parts[token][0]

    def step(self, state: int, token: int) -> bool:
        if state == self.START:
            return token not in self.gone
        key = state * self.size + token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= MAX_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._follows(state, token)
        return known

    def encode(self, symbols: str) -> list[int]:
        """Ids of one pre-split word, its last symbol marked as the end of the word."""
        text = symbols + WORD_END
        last, end = len(symbols), len(text)
        path: list[tuple[int, int, int]] = []  # start, end, token
        dead: set[tuple[int, int]] = set()  # (position, state) without a way to the end
        at, state, reach = 0, self.START, end
        while at < end:
            found = None
            top = min(reach, end, at + self.longest)
            while top > at:
                if top == end or top < last:  # the last symbol and its mark are one
                    token = self.vocab.get(text[at:top])
                    if token is not None and (top, token) not in dead and self.step(state, token):
                        found = token
                        break
                top -= 1
            if found is not None:
                path.append((at, top, found))
                at, state, reach = top, found, end
                continue
            if not path:
                raise ValueError(f"the vocabulary cannot spell {symbols!r}")
            dead.add((at, state))
            at, top, _ = path.pop()
            state = path[-1][2] if path else self.START
            reach = top - 1
        return [token for _, _, token in path]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.label[i] for i in ids)


class Encoder:
    """Text to ids: special tokens, normalisation, pre-split, then the automaton per word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name, members in ((r"\s", WHITE), (r"\p{L}", _ranges("L")), (r"\p{N}", _ranges("N"))):
            split = split.replace(f"[{name}]", f"[{members}]").replace(name, members)
        self.pieces = re.compile(split)
        self.white = re.compile(f"[{WHITE}]+")
        self.at_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.marks = tuple({t[:2] for t in self.special})
        self.bytes = byte_symbols()
        self.words = _Words(self)

    def word(self, chunk: str) -> tuple[str, str]:
        """Ids and labels of one run without white space."""
        ids: list[int] = []
        for piece in self.pieces.findall(chunk):
            ids += self.automaton.encode("".join([self.bytes[b] for b in piece.encode("utf-8")]))
        return " ".join(map(str, ids)), self.automaton.decode(ids)

    def _plain(self, text: str) -> list[tuple[str, str]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        text = text.lower()
        odd = any(c in text for c in _NOT_WHITE)
        chunks = self.white.split(text) if odd else text.split()
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        words = self.words
        return [words[c] for c in chunks]

    def encode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by a space, and the text decoded from them."""
        if not any(m in text for m in self.marks):
            found = self._plain(text)
        else:
            found, at = [], 0
            for m in self.at_special.finditer(text):
                found += self._plain(text[at : m.start()])
                found.append((str(self.special[m[0]]), m[0]))
                at = m.end()
            found += self._plain(text[at:])
        return " ".join([a for a, _ in found if a]), " ".join([b for _, b in found if b])


class _Words(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> tuple[str, str]:
        value = self[chunk] = self.encoder.word(chunk)
        return value


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker: the vocabulary is read and compiled once."""
    return Encoder(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_KEEP = {
    "digest": "ids_sha256 string, decoded_sha256 string",
    "ids": "ids array<int>, ids_sha256 string, decoded_sha256 string",
    "tokens": "ids string, decoded string",
}


def encode_documents(docs: DataFrame, path: str, keep: str = "digest") -> DataFrame:
    """Per document: doc_id, n_tokens, and what ``keep`` names: the SHA-256 of the joined ids and of the decoded
    text (``digest``), these and the ids (``ids``), or ids and decoded text as strings (``tokens``).

    The whole text is encoded; a null text counts as empty and gives no tokens. Repeated rows give
    repeated rows; other columns are dropped. ``path`` is a vocabulary file every executor can read.
    """
    if keep not in _KEEP:
        raise ValueError(f"keep is one of {', '.join(_KEEP)}")
    names = [c.split(" ")[0] for c in _KEEP[keep].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts, out = [], {name: [] for name in names}
            for text in batch.column("text"):
                ids, decoded = enc.encode(text.as_py())
                counts.append(ids.count(" ") + 1 if ids else 0)
                found = (ids, decoded) if keep == "tokens" else (_sha(ids), _sha(decoded))
                if keep == "ids":
                    found = (np.array(ids.split(), np.int32), *found)
                for name, value in zip(names, found, strict=True):
                    out[name].append(value)
            kinds = [pa.list_(pa.int32()) if keep == "ids" and name == "ids" else pa.string() for name in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), *[pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)]],
                names=["doc_id", "n_tokens", *names],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"doc_id bigint, n_tokens bigint, {_KEEP[keep]}")
