"""BPE, fingerprints and mixing against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from edge_cases import TEXTS, edge_documents, no_documents, with_edges, words
from oracle import compare, duck

from sessionloom.llm import bpe, fingerprints, mixing
from sessionloom.llm.tables import table, vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def _library(t, text):
    ids = t.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)


def test_automaton_matches_the_library_on_random_texts(library):
    rng = random.Random(5)
    letters = "abcdeinorsth '!.,0123é́İΣẞ中ก\U0001f600\n\t\x1c\x85\xa0　²<|>_-'sI'LL٠\x00"
    encoder = bpe.encoder(vocabulary())
    for n in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        if n % 10 == 0:
            text = text[:5] + "<|endoftext|>" + text[5:] + "<|startoftext|>"
        assert encoder.encode(text) == _library(library, text), text


def test_automaton_paths_are_the_merge_results():
    rng = random.Random(1)
    for _ in range(60):
        merges, symbols = [], ["a", "b", "c"]
        ends = [s + bpe.WORD_END for s in symbols]
        pool = symbols + ends
        for _ in range(rng.randint(1, 10)):
            u, v = rng.choice([p for p in pool if not p.endswith(bpe.WORD_END)]), rng.choice(pool)
            if u + v not in pool:
                merges.append((u, v))
                pool.append(u + v)
        automaton = bpe.Automaton({t: n for n, t in enumerate(pool)}, merges)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            parts = [*word[:-1], word[-1] + bpe.WORD_END]
            while True:
                found = [(merges.index(p), n) for n, p in enumerate(zip(parts, parts[1:])) if p in merges]
                if not found:
                    break
                _, n = min(found)
                parts[n : n + 2] = [parts[n] + parts[n + 1]]
            assert [automaton.label[i] for i in automaton.encode(word)] == parts


def test_bpe_query_matches_the_library(spark, sf_dir, library):
    docs = with_edges(spark, table(spark, sf_dir, "documents"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.encode_documents(docs, vocabulary()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids, decoded = _library(library, texts[r.doc_id])
        assert r.n_tokens == (len(ids.split(" ")) if ids else 0)
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def _edited(texts, ids):
    for n, i in enumerate(ids):
        text, after = texts[i], texts[ids[(n + 1) % len(ids)]]
        cut = len(text) // 4
        yield i, text[: len(text) - cut] + after[:cut]


def test_fingerprints_edit_and_likeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    rows = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    assert sorted(rows) == ids
    by_text, gap = {}, []
    for i, edited in _edited(texts, ids):
        r = rows[i]
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
        a, b = Counter(words(texts[i])), Counter(words(edited))
        union = sum((a | b).values())
        gap.append(r.near_edited - (sum((a & b).values()) / union if union else 1.0))
    assert abs(sum(gap) / len(gap)) < 0.03
    assert math.sqrt(sum(g * g for g in gap) / len(gap)) < 0.12


def test_fingerprints_of_odd_rows(spark):
    rows = {r.doc_id: r for r in fingerprints.fingerprint(edge_documents(spark), 8).collect()}
    assert len(rows) == 12  # the repeated row counts once
    assert rows[3].fingerprint == rows[4].fingerprint == rows[5].fingerprint == ""
    assert rows[3].near_edited == 1.0 and rows[3].near_next == 1.0
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1.0
    assert rows[None].edited_sha256 == hashlib.sha256(b"no id here atThe ").hexdigest()
    assert fingerprints.fingerprint(no_documents(spark), 4).count() == 0


def test_mix_equals_its_sql(spark, sf_dir):
    assert compare(mixing.mix(table(spark, sf_dir, "documents")), duck(sf_dir), mixing.ORACLE) == ""


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(edge_documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    sizes = Counter()
    for _, text, _, source in TEXTS:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    left, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in full]
        level = (left - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
    by_size = {}
    for r in rows:
        assert r.copies <= 2 and r.taken == r.copies * r.size
        by_size.setdefault(r.source_size, r.target)
    for s in order:
        assert by_size[sizes[s]] == pytest.approx(target[s])
    assert mixing.mix(no_documents(spark)).count() == 0
    assert mixing.emit(no_documents(spark)).columns == no_documents(spark).columns


def test_mix_comes_near_targets_and_emits_what_it_takes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    taken = mixing.mix(docs)
    for r in taken.groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) <= 2 * r["max(size)"]
    copies = {r.doc_id: r.copies for r in taken.collect() if r.copies}
    assert Counter(r.doc_id for r in mixing.emit(docs).collect()) == Counter(copies)
