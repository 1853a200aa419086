"""Near-duplicates, passages, embeddings and WARC against brute force and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_cases import edge_documents, no_documents, words

from sessionloom.llm import dart_minhash, embedding_dedup, passages, warc
from sessionloom.llm.components import components
from sessionloom.llm.tables import table


class _Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, 100 + n) for n in range(1, 30)] + [(7, 7)]
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(40)]
    u = _Union({x for e in edges if e[0] != e[1] for x in e})
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: u.find(x) for x in u.up}


def _classes(texts, like=0.8):
    grams = {}
    for i, t in texts.items():
        w = words(t)
        if w:
            grams[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    where = defaultdict(list)
    for i, g in grams.items():
        for s in g:
            where[s].append(i)
    shared = Counter()
    for s, ids in where.items():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                shared[(b, a)] += min(grams[a][s], grams[b][s])
    u = _Union(texts)
    for (a, b), m in shared.items():
        if m >= like * (sum(grams[a].values()) + sum(grams[b].values()) - m):
            u.join(a, b)
    return {i: u.find(i) for i in texts}


def test_near_duplicate_classes_are_exact_on_the_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = _classes({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())


def test_families_of_edited_copies_need_open_bands(spark):
    rng = random.Random(8)
    texts = {}
    for family in range(3):
        root = [f"w{family}x{n}" for n in range(120)]
        for n in range(40):
            w = list(root)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            texts[family * 100 + n] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    want = _classes(texts)
    assert sum(got[i] != want[i] for i in texts) == 0


def test_blocks_of_a_large_cluster_meet(spark, monkeypatch):
    left = spark.createDataFrame(
        [(b, n, n, f"{n // 2} a b c d e f g h i j k l m") for n in range(40) for b in (1, 2)],
        "band bigint, id bigint, component bigint, text string",
    )
    texts = left.select("id", "text").distinct()
    found = dart_minhash._across(left.select("band", "id", "component"), texts, 0.99, 5, block=8).collect()
    assert {(r.a, r.b) for r in found} == {(n + 1, n) for n in range(0, 40, 2)}


def test_dart_samples_collide_like_weighted_jaccard():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 80, dtype=np.uint64)
    a, b = rng.uniform(0, 3, 80), rng.uniform(0, 3, 80)
    a[:30], b[50:] = 0, 0
    k = 4000
    sig = [dart_minhash.dart_samples(keys[w > 0], w[w > 0], np.zeros((w > 0).sum(), np.int64), 1, k)[0] for w in (a, b)]
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_near_duplicates_of_odd_rows(spark):
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(edge_documents(spark)).collect()}
    assert got == {i: (1 if i == 2 else i) for i in range(1, 12)}
    assert dart_minhash.near_duplicates(no_documents(spark)).count() == 0


def test_compact_windows_are_the_wide_nodes_of_cartesian_trees():
    rng = np.random.default_rng(1)
    for n in range(150):
        sizes = rng.integers(0, 30, 4)
        v = rng.integers(0, 2**63, int(sizes.sum()), dtype=np.uint64)
        if n % 2:
            v = (v % np.uint64(5)) << np.uint64(40)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        got = set(zip(*[x.tolist() for x in passages.compact_windows(v, starts, 6)], strict=True))
        rank = [(int(x) >> 26, p) for p, x in enumerate(v)]
        want = set()
        for t in range(4):
            for c in range(starts[t], starts[t + 1]):
                a = b = c
                while a > starts[t] and rank[a - 1] > rank[c]:
                    a -= 1
                while b < starts[t + 1] - 1 and rank[b + 1] > rank[c]:
                    b += 1
                if b - a + 1 >= 6:
                    want.add((c, a, b))
        assert got == want


def test_passages_cover_every_exact_repeat_and_nothing_else(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    rows = passages.repeated_passages(docs).collect()
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.first_word, r.end_word))
    seen = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            if len(seen[tuple(w[j : j + 50])]) > 1:
                assert any(a <= j and j + 50 <= b for a, b in spans[i]), (i, j)
    five = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 4):
            five[tuple(w[j : j + 5])].add(i)
    for r in rows:
        w = texts[r.doc_id][r.first_word : r.end_word]
        assert len(w) >= 50
        assert sum(len(five[tuple(w[j : j + 5])]) > 1 for j in range(len(w) - 4)) >= 0.8 * (len(w) - 4)


def test_passages_of_odd_rows(spark):
    rng = random.Random(2)
    common = " ".join(f"p{n}" for n in range(60))
    own = lambda n: " ".join(f"o{rng.random()}" for _ in range(n))
    docs = edge_documents(spark).select("doc_id", "text").union(
        spark.createDataFrame(
            [(20, f"{own(30)} {common} {own(10)}"), (21, f"{common} {own(80)}"), (22, own(200)), (23, " ".join(common.split()[:49]))],
            "doc_id bigint, text string",
        )
    )
    got = sorted((r.doc_id, r.first_word, r.end_word, r.similar_to, r.class_id) for r in passages.repeated_passages(docs).collect())
    assert got == [(20, 30, 90, 21, 20), (21, 0, 60, 20, 20)]
    assert passages.repeated_passages(no_documents(spark)).count() == 0


def test_contexts_of_different_surroundings_differ(spark):
    docs = [(i, " ".join(f"w{i}x{n}" for n in range(20_000))) for i in range(4)]
    rows = passages.windows(spark.createDataFrame(docs, "id bigint, text string")).collect()
    for column, side in (("before", -passages.SIDE), ("after", passages.SIDE)):
        places = {(r.id, r.c + side) for r in rows if r[column]}
        assert len(places) > 3000
        assert len({r[column] for r in rows if r[column]}) == len(places)


def test_passages_behind_an_earlier_document_that_shares_less(spark):
    """Pairs share 50 to 60 words exactly; earlier documents hold most of these words and differ in the rest."""
    rng = random.Random(11)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    docs, want = [], {}

    def put(passage, expected):
        before = rng.randint(10, 60)
        docs.append((len(docs), " ".join(own(before) + passage + own(rng.randint(10, 60)))))
        if expected:
            want[docs[-1][0]] = (before, before + len(passage))

    common = [f"c{n}" for n in range(45)]
    for _ in range(20):
        put(common + own(5), False)
    for _ in range(40):
        shared = common + own(5)
        put(shared, True)
        put(shared, True)
    template = [f"t{n}" for n in range(56)]
    filled = lambda: [own(1)[0] if n in (12, 30, 47) else w for n, w in enumerate(template)]
    for _ in range(20):
        put(filled(), False)
    for _ in range(40):
        shared = filled()
        put(shared, True)
        put(shared, True)
    twice = own(60)
    put(twice + own(100) + twice, False)
    put(twice, True)
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.first_word, r.end_word))
    lost = [i for i, (a, b) in want.items() if not any(x <= a and b <= y for x, y in spans[i])]
    assert lost == []
    assert sum(y - x >= 60 for x, y in spans[len(docs) - 2]) == 2  # both places of the first document


def test_alike_passages_around_a_phrase_of_many_documents_are_all_found(spark):
    """30 words stand in 40 earlier documents; 60 pairs share them and 30 more, with one word changed: no pair is lost."""
    rng = random.Random(12)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    common = [f"c{n}" for n in range(30)]
    docs = [own(rng.randint(10, 60)) + common + own(60) for _ in range(40)]
    for n in range(60):
        more = own(30)
        edited = list(more)
        edited[15] = own(1)[0]
        docs += [own(rng.randint(10, 60)) + (common + x if n % 2 else x + common) + own(40) for x in (more, edited)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()}
    assert got == {i: i - i % 2 for i in range(40, len(docs))}


def test_a_word_said_over_and_over_is_no_diagonal_a_place(spark, monkeypatch):
    """One document says a word 600 times, others 38 times and nothing else alike: their meetings stay runs."""
    rng = random.Random(15)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    docs = [own(50) + ["over"] * n + own(50) for n in (38, 38, 38, 600, 700)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    kept, write = [], passages.materialise
    monkeypatch.setattr(passages, "materialise", lambda d, label="stage": kept.append((label, write(d, label))) or kept[-1][1])
    got = sorted((r.doc_id, r.first_word, r.end_word, r.class_id) for r in passages.repeated_passages(df).collect())
    assert [r[0] for r in got] == [3, 4] and all(r[3] == 3 and r[1] >= 43 and r[2] - r[1] >= 600 for r in got)
    rest = [d for label, d in kept if label == "pairs"][-1]
    assert 0 < sum(len(r.parts) for r in rest.collect()) < 1500


@pytest.mark.parametrize("run, want", [
    ((7, 1, 3, 9), [(7, 3, 9)]),
    ((7, 3, 3, 9), [(7, 3, 9), (8, 4, 10), (9, 5, 11)]),
    ((7, -3, 3, 9), [(5, 3, 9), (6, 3, 9), (7, 3, 9)]),
])
def test_runs_are_laid_out_as_diagonals(run, want):
    again = [np.array([x, x], np.int64) for x in run]
    again[2][1] += 1
    again[3][1] += 1
    assert passages._diagonals(*again) == [(d, lo, hi + 1) for d, lo, hi in want]


def test_no_short_passage_with_a_word_put_in_is_lost(spark):
    rng = random.Random(14)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    docs = []
    for _ in range(100):
        passage = own(56)
        docs += [own(30) + p + own(30) for p in (passage, passage[:28] + own(1) + passage[28:])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()}
    assert got == {i: i - i % 2 for i in range(len(docs))}


def test_phrases_of_alike_texts_meet(spark):
    assert passages._run(50, 0.8, 5) == 19
    rng = random.Random(13)
    pairs = []
    for n in range(200):
        shared = [f"s{n}x{k}" for k in range(23)]  # 19 shingles
        pairs += [(2 * n + k, " ".join([f"o{rng.random()}" for _ in range(rng.randint(0, 50))] + shared + [f"o{rng.random()}" for _ in range(40)])) for k in (0, 1)]
    rows = passages.phrases(spark.createDataFrame(pairs, "id bigint, text string")).collect()
    keys = defaultdict(set)
    for r in rows:
        keys[r.id].add(r.key)
    assert all(keys[2 * n] & keys[2 * n + 1] for n in range(200))


EDITS = [(60, 1), (95, 1), (100, 2), (200, 4), (300, 6), (60, 0)]


def test_alike_passages_with_spread_edits_are_found(spark):
    """Passages with single words changed at even distances, all of likeness 0.8 or more: 360 pairs, recall 0.9."""
    rng = random.Random(21)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    docs, want = [], defaultdict(list)
    for words, changes in EDITS:
        for _ in range(60):
            passage = own(words)
            edited = list(passage)
            for n in range(changes):
                edited[(n * 2 + 1) * words // (2 * changes)] = own(1)[0]
            five = [Counter(tuple(p[j : j + 5]) for j in range(words - 4)) for p in (passage, edited)]
            both = sum((five[0] & five[1]).values())
            assert both / (2 * (words - 4) - both) >= 0.8
            for p in (passage, edited):
                before = rng.randint(10, 90)
                docs.append((len(docs), " ".join(own(before) + p + own(rng.randint(10, 90)))))
                want[words, changes].append((len(docs) - 1, before, before + words))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    spans = {r.doc_id: (r.first_word, r.end_word) for r in rows}
    for kind, places in want.items():
        found = sum(min(b, spans.get(i, (0, 0))[1]) - max(a, spans.get(i, (0, 0))[0]) >= 0.8 * (b - a) for i, a, b in places)
        assert found >= 0.9 * len(places), (kind, found, len(places))
    assert all(r.class_id == r.doc_id - r.doc_id % 2 for r in rows)


def test_words_put_in_or_left_out(spark):
    """One word more or less in the middle: halves of 35 words only count together, halves of 55 may come apart."""
    rng = random.Random(22)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    docs = []
    for n in range(120):
        half = 35 if n % 2 else 55
        passage = own(2 * half)
        edited = passage[:half] + (own(1) if n % 4 < 2 else []) + passage[half + (n % 4 >= 2) :]
        docs += [(2 * n + k, half, " ".join(own(40) + p + own(40))) for k, p in enumerate((passage, edited))]
    df = spark.createDataFrame(docs, "doc_id bigint, half int, text string")
    covered = Counter()
    for r in passages.repeated_passages(df).collect():
        covered[r.doc_id] += min(r.end_word, 40 + 2 * docs[r.doc_id][1]) - max(r.first_word, 40)
    for half in (35, 55):
        mine = [i for i, h, _ in docs if h == half]
        assert sum(covered[i] >= 0.8 * 2 * half for i in mine) >= 0.9 * len(mine), half


@pytest.mark.parametrize("pattern, width, want", [
    ("s" * 25 + "x" * 5 + "s" * 26, 46, [(0, 56)]),
    ("x" * 30 + "s" * 50 + "x" * 30, 46, [(30, 80)]),
    ("s" * 60 + "x" * 60 + "s" * 60, 46, [(0, 60), (120, 180)]),
    ("s" * 40 + "x" * 40, 46, []),
    ("", 46, []),
])
def test_segments_join_runs_while_the_union_is_alike(pattern, width, want):
    same = np.array([c == "s" for c in pattern], bool)
    assert sorted(passages._segments(same, width, 8 / 9)) == want


@pytest.mark.parametrize("cell, block", [(10_000, 10_000), (40, 16)])
def test_embedding_links_equal_brute_force(spark, cell, block):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base + rng.normal(scale=0.07, size=base.shape), base + rng.normal(scale=0.12, size=base.shape), base[:9], 3 * base[:5]])
    vectors = [list(map(float, np.float32(v))) for v in x]
    vectors += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [1.0, 2.0], [2.0, 4.1]]
    df = spark.createDataFrame([(n, v, 1) for n, v in enumerate(vectors)] + [(None, vectors[0], 1)], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.95, cell, block).collect()}
    ok = [n for n, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    u, links = _Union(range(len(vectors))), Counter()
    for n, a in enumerate(ok):
        for b in ok[:n]:
            p, q = np.array(vectors[a]), np.array(vectors[b])
            if len(p) == len(q) and p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.95:
                links[a] += 1
                links[b] += 1
                u.join(a, b)
    assert got == {n: (links[n], u.find(n), u.find(n) == n) for n in range(len(vectors))} | {None: (0, None, True)}


def test_no_embeddings(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0


def _pages(spark):
    rows = [
        (5, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "http://b", None), (8, "http://c", ""), (9, "u\r\nWARC-Type: x", "a\r\n\r\nb"),
        (10, "http://d", "z" * 300_000), (11, "http://e", "twice"), (11, "http://e", "twice"), (None, "http://f", "<p>é</p>"), (None, "http://g", "alone"),
    ]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload string")


def test_warc_round_trip_of_odd_pages(spark):
    pages = _pages(spark)
    got = sorted((tuple(r)[:5] for r in warc.round_trip(pages).collect()), key=str)
    first = {}
    for r in sorted((r for r in pages.collect()), key=lambda r: (r.page_id is None, r.page_id)):
        first.setdefault(r.html or "", r.page_id)
    want = []
    for r in pages.collect():
        b = (r.html or "").encode()
        again = first[r.html or ""] != r.page_id
        want.append(
            (r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[r.html or ""] if again else None)
        )
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reads_a_selection_by_ranges(spark, tmp_path):
    pages = _pages(spark).filter("page_id is not null")
    index = warc.write_archives(pages, str(tmp_path), least=100)
    rows = warc.read_records(index.filter("page_id in (2, 9, 10)"), str(tmp_path)).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert {r.page_id: r.payload for r in rows} == {n: html[n] for n in (2, 9, 10)}
    assert all(r.record_type == "response" for r in rows)  # short payloads are never revisits
    assert list(warc._ranges([0, 10, 20, 10**6, 10**6 + 5], [10, 10, 10, 5, 5])) == [(0, 3), (3, 5)]


def test_members_left_over_are_not_compared_each_with_each(spark, monkeypatch):
    """Copies of a text with words changed at random places: what lies in no passage meets few others, not all."""
    rng = random.Random(31)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    text = own(300)
    docs = [[w if rng.random() > 0.06 else own(1)[0] for w in text] for _ in range(80)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    kept, write = [], passages.materialise
    monkeypatch.setattr(passages, "materialise", lambda d, label="stage": kept.append((label, write(d, label))) or kept[-1][1])
    spans = defaultdict(list)
    for r in passages.repeated_passages(df).collect():
        assert r.class_id == 0
        spans[r.doc_id].append((r.first_word, r.end_word))
    assert len(spans) == 80
    rest = [d for label, d in kept if label in ("pairs", "left")][-1]
    assert rest.count() < 80 * 79 / 2 / 8
    shared = [{tuple(w[n : n + 50]): n for n in range(251)} for w in docs]  # 50 words that two have in common are found in both
    for i in range(80):
        for j in range(i):
            for n in (shared[i][p] for p in shared[i].keys() & shared[j].keys()):
                assert all(any(a <= n and n + 50 <= b for a, b in spans[k]) for k in (i, j))


def test_places_at_even_distances_are_one():
    text, key = np.array([0] * 9 + [1] * 3), np.array([5] * 7 + [6] * 2 + [5] * 3)
    c = np.array([1, 2, 3, 9, 30, 32, 34, 1, 2, 40, 44, 48])
    order, new, size, step = passages._chains(text, key, c, 10)
    got = [(int(text[order][n]), int(key[order][n]), int(c[order][n]), int(k), int(s)) for n, k, s in zip(new, size, step, strict=True)]
    assert got == [(0, 5, 1, 3, 1), (0, 5, 9, 1, 1), (0, 5, 30, 3, 2), (0, 6, 1, 2, 1), (1, 5, 40, 3, 4)]


def test_a_word_order_said_over_and_over_is_found(spark):
    """Two words by turns, 60 and 90 of them in other surroundings: places at even distances stand for all of them."""
    rng = random.Random(32)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    docs = [own(40) + ["to", "fro"] * n + own(40) for n in (30, 45, 20)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {r.doc_id: (r.first_word, r.end_word) for r in passages.repeated_passages(df).collect()}
    assert got.keys() == {0, 1} and all(b - a >= 60 for a, b in got.values())


def test_members_dealt_to_cells_all_meet(spark, monkeypatch):
    """30 words stand in 30 documents; 12 pairs of later ones share 30 more, with a word changed, and meet in some cell."""
    monkeypatch.setattr(passages, "CELL", 2)
    rng = random.Random(33)
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    common = [f"c{n}" for n in range(30)]
    docs = [own(30) + common + own(60) for _ in range(30)]
    for _ in range(12):
        more = own(30)
        docs += [own(20) + common + x + own(40) for x in (more, more[:15] + own(1) + more[16:])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()}
    assert got == {i: i - i % 2 for i in range(30, len(docs))}
