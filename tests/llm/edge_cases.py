"""Documents with every odd case, shared by the tests of the training-data operators."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, id int"
_LONG = "wörter und mehr words 12.5 " * 6000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n", "en", "a"),
    (6, "one", "en", None),
    (7, "a b", "en", "c"),
    (8, _LONG, "de", "a"),
    (9, "é́ ß \U0001f600 x\x0by <|endoftext|> it's 2nd", "fr", "\U00010400"),
    (10, "x" * 30_000, "en", "b"),
    (11, "repeated row", "en", "a"),
    (11, "repeated row", "en", "a"),
    (None, "no id here at all", "en", "a"),
]


def edge_documents(spark):
    rows = [(*t, len(t[1] or ""), 0.5, "clash", 7) for t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def with_edges(spark, docs):
    """The texts of a corpus and the odd ones, under ids of their own."""
    from pyspark.sql import functions as F

    odd = edge_documents(spark).select((F.col("doc_id") + 10**9).alias("doc_id"), "text")
    return docs.select("doc_id", "text").union(odd)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
