"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document of a source has the same number of expected copies, the source's target over its size.
Documents are laid out one after the other, ordered by size so that every stretch of the line has its
share of long and short ones; a document is emitted once for each integer boundary that its stretch,
shifted by one random offset per source, crosses. The prefix sum is distributed: rows are range
partitioned and sorted once, and each block adds the rows of the earlier blocks of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.tables import count_words
from sessionloom.sources.scratch import materialise

_ROW_BITS = 33  # monotonically_increasing_id: task number above, row in task below


def _fraction(text: Column) -> Column:
    """A number in (0, 1) from the md5 of a text."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") + 0.5) / 2.0**32


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets per source from its size: ``share`` of all sizes dealt by weight, none above ``most`` times its size.

    Takes one row per source (source, source_size) and works on that small table alone. Sources go by
    code point, null last; the weights repeat in that order. Dealing the excess again until no source is
    above its limit ends at one level per unit of weight: with the sources in the order in which they
    reach their limits, it is the largest level left after any number of them are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, weights)), (number - 1) % len(weights) + 1)
    table = sizes.select("*", number.alias("source_no"), weight.alias("weight"))
    limit = most * F.col("source_size")
    full = Window.orderBy(limit / F.col("weight"), "source_no")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rest = share * F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    levels = table.withColumn("__level", rest / open_weight)
    target = F.least(limit, F.max("__level").over(whole) * F.col("weight"))
    return levels.withColumn("target", target.cast("double")).drop("__level")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, copies, taken.

    ``size`` is the number of words (null text: 0) and ``taken`` is copies times size. A null source is
    a source of its own. Sources without words have target 0. Repeated rows are documents of their
    own; which of several equal rows is taken more often is left open. Other columns are dropped.
    """
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            count_words(F.col("text")).cast("bigint").alias("size"),
        ),
        "sized",
    )
    sources = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
    )
    sources = sources.withColumnRenamed("source", "__source")
    named = sized.join(sources, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "size", "source_no", "source_size", "target",
        F.concat_ws(":", F.lit(seed), "source").alias("__name"),
    )
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keys = ["source_no", "size", "__tie", "doc_id"]
    placed = materialise(
        named.withColumn("__tie", tie)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.monotonically_increasing_id().alias("__slot"))
        .drop("__tie"),
        "placed",
    ).withColumn("__block", F.shiftright("__slot", _ROW_BITS))
    blocks = placed.groupBy("source_no", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__slot").alias("__first"))
    earlier = Window.partitionBy("source_no").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "source_no", "__block", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    rank = F.col("__slot") - F.col("__first") + F.col("__before")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _fraction(F.col("__name"))
    crossed = F.floor((rank + 1) * each + offset) - F.floor(rank * each + offset)
    return (
        placed.join(offsets, ["source_no", "__block"])
        .withColumn("copies", crossed.cast("bigint"))
        .select(
            "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
        )
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as ``mix`` takes it, with its own columns.

    A doc_id names one document here: if rows share one, all of them are emitted as often as the row
    of that id that is taken most.
    """
    taken = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    kept = docs.join(taken.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))
    return kept.select(*docs.columns, again.alias("__copy")).drop("__copy")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM per_source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(source_no - 1) % 3 + 1] AS weight FROM numbered),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (
               ORDER BY 2.0::DOUBLE * source_size / weight, source_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source_no
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM weighed),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (max(lv) OVER ()) * weight)::DOUBLE AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target,
         (row_number() OVER (PARTITION BY s.source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1) AS rk,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each_doc,
         (('0x' || substr(md5(concat_ws(':', 'mix', s.source)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, (floor((rk + 1) * each_doc + u) - floor(rk * each_doc + u))::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM copied
"""
