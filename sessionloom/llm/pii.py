"""Personal data by weak supervision.

Wide patterns propose spans. Labelers vote on each: exact patterns and checksums, gazetteers of known
prefixes and endings, and words of the context. The votes of all documents are counted by pattern, a
table bounded by the number of votes and shapes. Expectation-maximisation estimates from it how reliable
each labeler is and how likely each pattern is personal data; a logistic classifier over votes and
shape, trained on these likelihoods, decides. Spans of the exact patterns are always kept.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.sources.scratch import materialise

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
CONTEXT = 32  # characters looked at on either side

# Exact patterns. A look-behind keeps a failing run from being tried again from each of its characters.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Wide patterns, which only propose.
_AT = r"\s?(?:\[at\]|\(at\)|\{at\}| at )\s?"
_DOT = r"\s?(?:\[dot\]|\(dot\)|\{dot\}| dot )\s?"
_WIDE = {
    "email": re.compile(rf"(?<![\w.])[\w.%+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{2,63}}){{1,4}}(?!\w)", re.I),
    "ip": re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])"),
    "card": re.compile(r"(?<![\w.])[0-9](?:[ .-]{0,2}[0-9]){12,18}(?![\w])"),
    "phone": re.compile(r"(?<![\w.+(-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
}

# Fixed word lists of the gazetteer and context labelers.
_ENDINGS = frozenset("com org net edu gov io info de fr es uk eu co".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")
_NEAR = {
    "email": "mail email contact write correo courriel kontakt schreib",
    "ip": "ip host server client address adresse login",
    "card": "card visa mastercard amex credit carte karte tarjeta payment",
    "phone": "phone tel call fax mobile telefon téléphone teléfono móvil whatsapp sms",
}
_NEAR = {k: re.compile(rf"\b(?:{'|'.join(v.split())})", re.I) for k, v in _NEAR.items()}
_AWAY = re.compile(r"\b(?:version|licen[cs]e|isbn|issn|doi|order|invoice|serial|token|password|hash|page|year|no\.|nr\.)", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        if found:
            yield first, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact patterns: kind by kind, leftmost and not overlapping within a kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _votes(kind: str, text: str, start: int, end: int, exact: bool) -> str:
    """Votes of the labelers (+, -, 0 for none) and the shape of the span, as one short text."""
    span, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    sound = {
        "email": "0",
        "ip": "+" if exact or ":" in span else "-",
        "card": "+" if 13 <= len(digits) <= 19 and _luhn(digits) else "-",
        "phone": "+" if 8 <= len(digits) <= 15 else "-",
    }[kind]
    known = {
        "email": "+" if re.split(r"\W+", span.lower().rstrip(")]}"))[-1] in _ENDINGS else "0",
        "ip": "-" if digits.strip("0") == "" else "0",
        "card": "+" if _ISSUERS.match(digits) else "-",
        "phone": "+" if span[0] in "+(" else "0",
    }[kind]
    near = "+" if _NEAR[kind].search(before) or _NEAR[kind].search(after[:16]) else "0"
    away = "-" if _AWAY.search(before) else "0"
    apart = "0" if not (before[-1:].isalnum() or after[:1].isalnum()) else "-"
    same = len(set(digits)) <= 2 and len(digits) > 6
    shape = f"{min(3, len(re.findall(r'[^0-9A-Za-z]+', span)))}{int(same)}"
    return f"{'+' if exact else '0'}{sound}{known}{near}{away}{apart}{shape}"


_LABELERS = 6


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Exact spans, and all proposed spans with their votes; a wide span is only proposed off the exact ones."""
    base = base_spans(text)
    out = [(k, a, b, _votes(k, text, a, b, True)) for k, a, b in base]
    wide = []
    if "dot" in text or "DOT" in text or "Dot" in text:
        wide.append("email")
    if _DIGIT.search(text):
        wide += ["card", "phone", *(["ip"] if text.count(":") >= 7 else [])]
    taken = sorted((a, b) for _, a, b in base)
    for kind in wide:
        for m in _WIDE[kind].finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((kind, m.start(), m.end(), _votes(kind, text, m.start(), m.end(), False)))
    return base, out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def propose(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the exact spans, and the other proposed spans with their votes; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, proposed = [], []
            for text in batch.column("text"):
                base, found = candidates(text.as_py() or "")
                exact.append(_joined(base))
                proposed.append([f"{k}|{v}|{a}|{b}" for k, a, b, v in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(exact, pa.string()), pa.array(proposed, pa.list_(pa.string()))],
                names=["doc_id", "base", "found"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, base string, found array<string>")


def _em(votes: list[str], count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each vote pattern to be personal data, and each labeler's vote rates by class.

    Starts from the balance of the votes; labelers are independent given the class.
    """
    side = np.array([["-0+".index(c) for c in v[:_LABELERS]] for v in votes])
    chance = 1 / (1 + np.exp(-2.0 * (side - 1).sum(axis=1)))
    rates = np.zeros((2, _LABELERS, 3))
    for _ in range(rounds):
        share = []
        for y, weight in enumerate((count * (1 - chance), count * chance)):
            share.append(weight.sum() + 1.0)
            for n in range(_LABELERS):
                rates[y, n] = np.bincount(side[:, n], weight, 3) + 0.5
            rates[y] /= rates[y].sum(axis=1, keepdims=True)
        log = [np.log(share[y]) + np.log(rates[y][np.arange(_LABELERS), side]).sum(axis=1) for y in (0, 1)]
        chance = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
    return chance, rates


def _classifier(votes: list[str], count: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Probabilities of a logistic model over votes and shape, fitted to the likelihoods."""
    columns = sorted({(n, c) for v in votes for n, c in enumerate(v)})
    x = np.array([[1.0] + [float(v[n] == c) for n, c in columns] for v in votes])
    weight = np.minimum(count, 1e6) / max(1.0, count.max()) * 1e3
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (weight * p * (1 - p))) @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (p - chance)) + 0.05 * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def learn(proposed: DataFrame, accept: float = ACCEPT) -> frozenset[str]:
    """The vote patterns ("kind|votes") that the final classifier takes for personal data.

    The driver gets one count per pattern: at most a few hundred per kind, however large the corpus.
    """
    pattern = F.substring_index("span", "|", 2)
    rows = (
        proposed.select(F.explode("found").alias("span")).groupBy(pattern.alias("pattern")).count().orderBy("pattern").collect()
    )
    by_kind = defaultdict(list)
    for r in rows:
        kind, votes = r["pattern"].split("|")
        by_kind[kind].append((votes, r["count"]))
    taken = set()
    for kind, found in by_kind.items():
        votes, count = [v for v, _ in found], np.array([c for _, c in found], float)
        chance, _ = _em(votes, count)
        final = _classifier(votes, count, chance)
        taken |= {f"{kind}|{v}" for v, p in zip(votes, final, strict=True) if p >= accept}
    return frozenset(taken)


def _accepted(base: str, found: list[str], taken: frozenset[str]) -> list[tuple[str, int, int]]:
    """Exact spans and the accepted others, earlier and longer ones first where those overlap."""
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
    more = []
    for s in found:
        kind, votes, a, b = s.split("|")
        if votes[0] != "+" and f"{kind}|{votes}" in taken:
            more.append((kind, int(a), int(b)))
    end = -1
    for k, a, b in sorted(more, key=lambda s: (s[1], -s[2])):
        if a >= end:
            spans.append((k, a, b))
            end = b
    return spans


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, counts of the exact spans by kind, their digest, and all spans.

    Spans are code point positions, end exclusive. Every row gives a row, repeated ones too; a text without
    personal data has counts 0 and spans ''.
    """
    proposed = materialise(propose(docs), "proposed")
    taken = learn(proposed, accept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
                kinds = [s.split(":", 1)[0] for s in base.split(",")]
                counts.append([kinds.count(k) for k in KINDS])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(_joined(_accepted(base, found, taken)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *[pa.array([c[n] for c in counts], pa.int64()) for n in range(len(KINDS))],
                    pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return proposed.mapInArrow(run, f"doc_id bigint, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in angle brackets.

    ``n_chars`` is counted anew where there is such a column; a null text stays null.
    """
    taken = learn(materialise(propose(docs), "proposed"), accept)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None else _masked(t, taken))

    masked = F.pandas_udf(run, "string")
    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _masked(text: str, taken: frozenset[str]) -> str:
    base, found = candidates(text)
    if not found:
        return text
    parts, at = [], 0
    for k, a, b in sorted(_accepted(_joined(base), [f"{k}|{v}|{a}|{b}" for k, a, b, v in found], taken), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*parts, text[at:]])
