"""Ids beyond 2^53 beside null ones, where a detour over floats would change them."""

import pytest

from sessionloom.llm import bpe, pii, warc
from sessionloom.llm.tables import vocabulary

BIG = 2**60
IDS = [BIG + 1, None, BIG + 3, BIG + 2, -BIG - 1, 2**63 - 1, 0]


def test_warc_ids(spark):
    html = ["same", "same", "same", "own", None, "", "x"]
    pages = spark.createDataFrame([(i, f"u{n}", h) for n, (i, h) in enumerate(zip(IDS, html))], "page_id bigint, url string, html string")
    got = {r.url: r for r in warc.round_trip(pages.coalesce(1)).collect()}
    assert [got[f"u{n}"].page_id for n in range(len(IDS))] == IDS
    assert [got[f"u{n}"].refers_to for n in range(len(IDS))] == [None, BIG + 1, BIG + 1, None, None, -BIG - 1, None]
    assert [got[f"u{n}"].record_type for n in range(3)] == ["response", "revisit", "revisit"]


def test_warc_reads_in_as_many_tasks_as_the_bytes_warrant(spark, tmp_path, monkeypatch):
    import os

    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat(sha2(string(id), 512), 40) as html").repartition(4)
    index = warc.write_archives(pages, str(tmp_path))
    size = index.selectExpr("sum(length)").first()[0]
    assert size == sum(os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path) if f.endswith(".gz"))
    assert warc.read_records(index, str(tmp_path)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(warc, "TASK_BYTES", size // 3)
    records = warc.read_records(index, str(tmp_path))
    assert records.selectExpr("spark_partition_id() as t").distinct().count() >= 3 and records.count() == 200


@pytest.mark.parametrize("operator", ["bpe", "pii", "tokens"])
def test_document_ids(spark, operator):
    docs = spark.createDataFrame([(i, f"mail a{n}@b.org") for n, i in enumerate(IDS)], "doc_id bigint, text string").coalesce(1)
    made = {
        "bpe": lambda: bpe.encode_documents(docs, vocabulary()),
        "tokens": lambda: bpe.encode_documents(docs, vocabulary(), keep="tokens"),
        "pii": lambda: pii.personal_data(docs),
    }[operator]()
    assert sorted(map(str, (r.doc_id for r in made.collect()))) == sorted(map(str, IDS))
