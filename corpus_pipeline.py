"""Cleaning a corpus: toxic documents go, near-duplicates go, personal data is masked, sources are mixed, text is encoded."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, dart_minhash, mixing, pii, toxicity
from sessionloom.llm.tables import id_remainder, table, vocabulary
from sessionloom.operators.ranking import with_row_number
from sessionloom.sources.scratch import materialise

TOXIC = 0.7
BATCH_ROWS = 1000  # documents a Python worker gets at once
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SCORE, _ROW, _LAST, _DIGEST = "__toxicity", "__row", "__without_id", "__digest"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored as toxic; learns from the labels that are not held out.

    Null and empty texts score as clean and stay; repeated rows are scored each.
    """
    labels = table(spark, sf_dir, "labels").filter(F.coalesce(id_remainder(F.col("doc_id"), 3) != 1, F.lit(False)))
    machine = toxicity.fit(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels)
    return toxicity.score(docs, machine, _SCORE).filter(F.col(_SCORE) < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id.

    Every row is a document of its own, numbered by doc_id (nulls last): two texts under one id are judged
    apart, of repeated rows one stays, and rows without an id take part. Texts without words are no
    copies of each other and stay.
    """
    keyed = docs.withColumns({_LAST: F.col("doc_id").isNull(), _DIGEST: F.sha2(F.coalesce("text", F.lit("")), 256)})
    numbered = with_row_number(keyed, [_LAST, "doc_id", _DIGEST], (), _ROW)
    texts = numbered.select(F.col(_ROW).alias("doc_id"), "text")
    gone = dart_minhash.near_duplicates(texts).filter(~F.col("kept")).select(F.col("doc_id").alias(_ROW))
    return numbered.join(gone, _ROW, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; a null text stays null, no row goes."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to twice; a document without words is not taken.

    Null sources are a source of their own; repeated rows are taken each.
    """
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, their count, and digests of the ids and of the decoded text.

    A null text has no tokens; repeated rows are encoded each.
    """
    return bpe.encode_documents(docs, vocabulary(), keep="ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None  # SQL cannot express the trained stages; the tests hold them against brute force


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to the workers in batches of BATCH_ROWS: of the default 10,000, each task holds several copies."""
    before = spark.conf.get(_ARROW)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_ARROW, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    with _small_batches(spark):
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
