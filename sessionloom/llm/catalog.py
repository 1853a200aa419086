"""Registered queries of the training-data operators and the SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import bpe, dart_minhash, embedding_dedup, fingerprints, language_model, merkle, mixing, passages, pii, quality, toxicity, vector_codes, warc
from sessionloom.llm.tables import table, vocabulary


def op5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_text_quality": quality.op12_text_quality,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "op7_language_model": op7_language_model,
    "op6_repeated_passages": op6_repeated_passages,
    "op2_embedding_duplicates": op2_embedding_duplicates,
    "op1_warc_round_trip": op1_warc_round_trip,
    "op10_personal_data": op10_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_source_mix": op4_source_mix,
    "op5_bpe_tokens": op5_bpe_tokens,
}
ORACLE: dict[str, str] = {
    "op4_source_mix": mixing.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
}
