"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The weighted terms of a text are its words and their counts S. For each component k and term, r and c
are gamma(2, 1) and b uniform, all drawn by hashing (term, k). With t = floor(ln S / r + b), the sample
is the term with the smallest ln a = ln c - r (t - b + 1), and the chance that two texts share a sample,
term and t, is their generalised Jaccard similarity. ln a is fixed by (term, t, k), so a component need
only keep the smallest value: two texts hold equal values when they hold equal samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.tables import WHITE
from sessionloom.operators.ranking import with_row_number
from sessionloom.sources.scratch import materialise

COMPONENTS = 32
_NO_ID = -(2**63)  # stands for a null doc_id in joins
_FINER = 4  # partitions per shuffle partition: a text becomes far more rows than it has bytes


def _pair(bits: Column) -> Column:
    """Product of the two uniforms in a 64-bit hash."""
    high = F.shiftrightunsigned(bits, 32) + F.lit(0.5)
    low = bits.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)
    return high * low * F.lit(2.0**-64)


def _values(term: Column, k: int, weights: list[Column]) -> list[Column]:
    """ln a of the term in component k for each weight; null for weight 0."""
    r = -F.log(_pair(F.xxhash64(term, F.lit(3 * k))))
    log_c = F.log(-F.log(_pair(F.xxhash64(term, F.lit(3 * k + 1)))))
    b = (F.shiftrightunsigned(F.xxhash64(term, F.lit(3 * k + 2)), 11)) * F.lit(2.0**-53)
    return [
        F.when(w > 0, log_c - r * (F.floor(F.log(w) / r + b) - b + 1)) for w in weights
    ]


def weighted_samples(terms: DataFrame, key: str, weights: list[str], components: int = COMPONENTS) -> DataFrame:
    """Signatures, one array of ``components`` ints per weight column, of rows (key, term, weights...).

    ``term`` is a 64-bit hash. A signature is null where the key has no term of positive weight.
    """
    made = [_values(F.col("term"), k, [F.col(w) for w in weights]) for k in range(components)]
    least = terms.groupBy(key).agg(
        *[F.min(made[k][n]).alias(f"__{w}_{k}") for k in range(components) for n, w in enumerate(weights)]
    )
    return least.select(
        key,
        *[
            F.when(
                F.col(f"__{w}_0").isNotNull(), F.array(*[F.hash(f"__{w}_{k}") for k in range(components)])
            ).alias(w)
            for w in weights
        ],
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components; 1 between two texts without words, 0 if only one has words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def hex_form(signature: Column, components: int = COMPONENTS) -> Column:
    parts = [F.element_at(signature, k + 1) for k in range(components)]
    return F.when(signature.isNotNull(), F.format_string("%08x" * components, *parts)).otherwise("")


def _neighbours(ids: DataFrame) -> DataFrame:
    """Per id: the next one, the previous one, and how much of it the previous one may need."""
    numbered = with_row_number(ids, ["id"], name="n")
    after = F.col("n") % F.col("group_rows") + 1
    nexts = numbered.select(after.alias("n"), F.col("id").alias("prev_id"), F.floor(F.col("chars") / 4).alias("need"))
    before = F.pmod(F.col("n") - 2, F.col("group_rows")) + 1
    back = numbered.select(before.alias("n"), F.col("id").alias("next_id"))
    return materialise(numbered.join(nexts, "n").join(back, "n").select("id", "next_id", "prev_id", "need"), "next")


def fingerprint(docs: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as
    many of the next document in order of doc_id; the first follows the last. A null text counts as
    empty. doc_id is the key: rows that share one count as one document, with the smallest of their
    texts; a null id counts as the smallest id. A text without words has the fingerprint ''.
    """
    spark = docs.sparkSession
    parts = _FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ids = texts.groupBy("id").agg(F.max(F.char_length("text")).alias("chars"))
    near = _neighbours(ids)
    one = texts.repartition(parts, "id").groupBy("id").agg(F.min("text").alias("text")).join(near, "id")
    heads = (
        one.select(F.col("prev_id").alias("id"), F.expr("substring(text, 1, cast(need as int))").alias("head"))
        .repartition(parts, "id")
    )
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    kept = F.expr("substring(text, 1, n - cut)")
    both = (
        one.join(heads, "id")
        .withColumns({"n": n, "cut": cut})
        .withColumns({"kept": kept})
        .withColumns({"edited": F.concat("kept", F.expr("substring(head, 1, cut)"))})
    )
    shared = F.regexp_extract("kept", r"(?s)^(.*[ \t-\r])", 1)  # words that end before the edit begins
    split = both.select("id", "text", "edited", shared.alias("shared"))
    split = split.withColumn("from", F.char_length("shared") + 1)
    pieces = F.array(
        F.struct(F.col("shared").alias("piece"), F.lit(1).alias("own"), F.lit(1).alias("changed")),
        F.struct(F.expr("substring(text, from)").alias("piece"), F.lit(1).alias("own"), F.lit(0).alias("changed")),
        F.struct(F.expr("substring(edited, from)").alias("piece"), F.lit(0).alias("own"), F.lit(1).alias("changed")),
    )
    word = F.explode(F.split("piece", WHITE))
    terms = (
        split.select("id", F.inline(pieces))
        .select("id", "own", "changed", word.alias("word"))
        .filter("word <> ''")
        .groupBy("id", F.xxhash64("word").alias("term"))
        .agg(F.sum("own").alias("own"), F.sum("changed").alias("changed"))
    )
    signed = weighted_samples(terms, "id", ["own", "changed"], components)
    facts = both.select("id", "next_id", "n", F.sha2("edited", 256).alias("edited_sha256"))
    table = materialise(facts.join(signed, "id", "left"), "signed")
    following = table.select(F.col("id").alias("next_id"), F.col("own").alias("next_own"))
    doc_id = F.when(F.col("id") != _NO_ID, F.col("id"))
    return table.join(following, "next_id").select(
        doc_id.alias("doc_id"),
        F.col("n").cast("bigint").alias("n_chars"),
        "edited_sha256",
        hex_form(F.col("own"), components).alias("fingerprint"),
        hex_form(F.col("changed"), components).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
