"""The Merkle manifest against a plain one-machine version."""

import hashlib
import zlib

import pytest
from edge_cases import edge_documents, no_documents

from sessionloom.llm import merkle
from sessionloom.llm.tables import table


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _leaf(row, text):
    return _sha(*[_field(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def _tree(nodes):
    """Top of a tree and the siblings of every leaf, level by level, as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, place in zip(paths, at):
            run = place // 3 * 3
            path.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
        nodes = [_sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [place // 3 for place in at]
    return nodes[0], paths


def naive(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    found = []
    for source in order:
        docs = sorted(((r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text), r) for r in sources[source]), key=lambda x: x[:3])
        found.append((docs, *_tree([d[2] for d in docs])))
    root, above = _tree([f[1] for f in found])
    out = []
    for (docs, subroot, paths), upper in zip(found, above):
        for (_, _, leaf, r), path in zip(docs, paths):
            tampered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            digest = _leaf(r, r.text.replace("\n", "")) if tampered else leaf
            for before, after in path + upper:
                digest = _sha(before, digest, after)
            proof = _sha(*[before + after for before, after in path + upper])
            out.append((r.doc_id, leaf, subroot, root, proof, digest, digest == root))
    return sorted(out, key=str)


def _equal(docs):
    got = merkle.manifest(docs)
    assert got.dtypes == [
        ("doc_id", "bigint"), ("leaf", "string"), ("subroot", "string"), ("root", "string"),
        ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean"),
    ]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == naive(docs.select("doc_id", "source", "lang", "n_chars", "text").collect())
    return rows


def test_whole_corpus(spark, sf_dir):
    rows = _equal(table(spark, sf_dir, "documents"))
    assert {r[-1] for r in rows} == {True, False}


def test_odd_rows_and_clashing_columns(spark):
    clash = edge_documents(spark).selectExpr(
        "*", "1 as key", "2 as leaf", "3 as steps", "4 as digest", "5 as idx", "6 as node", "7 as shown", "8 as high"
    )
    _equal(clash)


@pytest.mark.parametrize("sizes", [[1], [2], [4], [1, 1], [1, 1, 1, 1], [30, 1, 1], [1, 28, 3, 9, 2, 1, 1, 82, 1, 1]])
def test_every_shape_of_tree(spark, sizes):
    rows = [
        (2**60 + 100 * s + i, f"line {i}\nnext", "en", None if s == 2 else f"s{s}", i)
        for s, n in enumerate(sizes)
        for i in range(n)
    ]
    _equal(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))


def test_no_rows(spark):
    assert merkle.manifest(no_documents(spark)).collect() == []


def test_sql_twin(spark, sf_dir):
    from oracle import compare, duck

    assert compare(merkle.op13_merkle_manifest(spark, sf_dir), duck(sf_dir), merkle.ORACLE) == ""
