"""Language model, toxicity, personal data and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from edge_cases import TEXTS, edge_documents, no_documents, with_edges, words

import corpus_pipeline
from sessionloom.llm import language_model, pii, toxicity
from sessionloom.llm.tables import table, vocabulary

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute_model(texts, rows):
    """Scores of a bigram model with plain dictionaries and exact probabilities in the same cells."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [w.encode() for w in words((t or "").translate(_LOWER))] + ["end"]) for i, t in texts]
    one, two, ctx = Counter(), Counter(), Counter()
    for i, t in tokens:
        if not held(i):
            one.update(t)
            pairs = list(zip(["start", *t], t, strict=False))
            two.update(pairs)
            ctx.update(h for h, _ in pairs)
    n, v = sum(one.values()), len(one)
    cells = Counter()
    for i, t in tokens:
        if held(i):
            continue
        pairs = list(zip(["start", *t], t, strict=False))
        own2, own1, own_h = Counter(pairs), Counter(t), Counter(h for h, _ in pairs)
        for h, w in pairs:
            c = ctx[h] - own_h[h]
            p2, p1 = (two[h, w] - own2[h, w]) / max(1, c), (one[w] - own1[w]) / max(1, n)
            b = language_model._bucket(np.array([c]))[0]
            cells[(b, language_model._level(np.array([p2]))[0], language_model._level(np.array([p1]))[0])] += 1
    frame = pd.DataFrame([(*k, m) for k, m in sorted(cells.items())], columns=["bucket", "two", "one", "n"])
    weights = language_model.learn_weights(frame, 1 / (v + 1))
    out = []
    for i, t in tokens:
        base = score = 0.0
        for h, w in zip(["start", *t], t, strict=False):
            l2, l1, l0 = weights[language_model._bucket(np.array([ctx[h]]))[0]]
            score += math.log10(l2 * two[h, w] / max(1, ctx[h]) + l1 * one[w] / max(1, n) + l0 / (v + 1))
            base += math.log10((one[w] + 1) / (n + v + 1))
        out.append((i, held(i), len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return Counter(out)


def test_language_model_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(60)
    docs = docs.select("doc_id", "text").union(edge_documents(spark).select("doc_id", "text"))
    docs = spark.createDataFrame(docs.collect(), "doc_id bigint, text string").repartition(3)
    rows = language_model.score_texts(docs, tokens=3000).collect()
    got = Counter((*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in rows)
    assert got == _brute_model([(r.doc_id, r.text) for r in docs.collect()], rows)


def test_language_model_of_nothing(spark):
    assert language_model.score_texts(no_documents(spark)).count() == 0


def test_language_model_beats_the_base_on_held_out_texts(spark, sf_dir):
    r = language_model.score_texts(table(spark, sf_dir, "documents")).filter("held_out").groupBy().sum("score", "base_score").first()
    assert r[0] > r[1]


def _labelled(spark):
    rng = random.Random(9)
    syllables = "ka lo mi ten ru sa vel no pir da".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["idiot", "moron", "loser"]
    rows = []
    for n in range(600):
        w = [word() for _ in range(rng.randint(8, 40))]
        toxic = n % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        rows.append((n, " ".join(w), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity_tolerates_gaps_and_inserted_letters(spark):
    data = _labelled(spark)
    machine = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"), turns=3)
    plain, spaced, signs, inserted, mild, empty = machine.score(
        pa.array(["kalo idiot mi loser", "kalo i d i o t mi l o s e r", "kalo i.d-i*o.t mi l_o_s_e_r", "kalo idxiot mi looser", "kalo mi tenru sa", ""])
    )
    assert min(plain, spaced, signs) > 0.7 and mild < 0.3 and empty < 0.5
    assert inserted > mild


def test_toxicity_query_on_held_out_rows(spark):
    data = _labelled(spark)
    rows = toxicity.toxic_documents(data.select("doc_id", "text"), data.select("doc_id", "toxic")).collect()
    truth = {r.doc_id: r.toxic for r in data.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (99, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    assert toxicity.toxic_documents(edge_documents(spark), labels).count() == len(TEXTS)
    assert toxicity.toxic_documents(edge_documents(spark), labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.toxic_documents(no_documents(spark), labels).count() == 0


_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for kind, pattern in _BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii._luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(8000):
        text = "".join(rng.choice("ab1.2@3-+ ()45A%_\né") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == _base(text), text


def test_personal_data_query(spark, sf_dir):
    docs = with_edges(spark, table(spark, sf_dir, "documents"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = _base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in base) for n in pii.KINDS)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.personal_data(no_documents(spark)).count() == 0


def test_weak_votes_add_hidden_spans_and_leave_numbers_alone(spark):
    rng = random.Random(4)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(n, f"mail me: user{n}@mail.example.com or call +1 {d(3)}-{d(3)}-{d(4)} now") for n in range(200)]
    rows += [(n, f"write mail to user{n} at mail dot example dot com please") for n in range(200, 240)]
    rows += [(n, f"order no. {d(3)}{n} costs {d(2)}.{d(2)} and version {d(1)}.{d(1)}") for n in range(240, 400)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[n].startswith("email:14:") for n in range(200, 240))
    assert all(got[n] == "" for n in range(240, 400))
    masked = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert masked[0] == "mail me: <EMAIL> or call <PHONE> now" and masked[210] == "write mail to <EMAIL> please"


def test_pipeline_stages_follow_one_another(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf_dir)
        assert out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    texts = [{r.doc_id: r.text for r in s.collect()} for s in seen]
    assert set(texts[1]) <= set(texts[0]) and set(texts[2]) < set(texts[1])
    for i, t in texts[3].items():
        want, at, parts = _base(texts[2][i]), 0, []
        assert (t == texts[2][i]) == (not want) or "<" in t
        assert not _base(t) or len(_base(t)) < len(want)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    last = corpus_pipeline.STAGES[-1][1](spark, seen[4], sf_dir).collect()
    assert len(last) == seen[4].count()
    for r in last[:100]:
        assert r.n_tokens == len(tokenizer.encode(texts[4][r.doc_id] or "", add_special_tokens=False).ids)


def test_pipeline_on_odd_rows(spark, tmp_path):
    edge_documents(spark).drop("score", "kept", "id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    no_documents(spark).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_carries_clashing_columns(spark, tmp_path):
    edge_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
    assert {(r.score, r.kept, r.id) for r in docs.collect()} == {(0.5, "clash", 7)}
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_copies_are_told_by_row_not_by_id(spark, sf_dir):
    words = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    near = words("a").replace("a59", "changed")
    rows = [
        (1, words("a")), (1, words("b")), (2, words("a")), (3, words("b")), (3, words("b")), (4, near), (5, words("c")),
        (None, words("a")), (None, words("d")), (6, None), (6, ""), (2**60 + 1, words("e")), (2**60 + 3, words("e")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, sf_dir).collect()), key=str)
    want = [(1, words("a")), (1, words("b")), (5, words("c")), (None, words("d")), (6, None), (6, ""), (2**60 + 1, words("e"))]
    assert got == sorted(want, key=str)


def test_pipeline_emits_the_token_ids(spark, sf_dir):
    import hashlib

    docs = table(spark, sf_dir, "documents")
    for r in corpus_pipeline.encode(spark, docs, sf_dir).limit(50).collect():
        assert len(r.ids) == r.n_tokens and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_pipeline_stages_get_small_batches_and_the_setting_comes_back(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(session, docs, folder):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows]}) for b in batches), "rows bigint")

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes)])
    got = [r.rows for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(got) == 3000 and max(got) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
