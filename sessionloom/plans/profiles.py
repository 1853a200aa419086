"""Queries: column profiles, shares, correlations, contingency, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.operators import joins, profile, quantiles, ranking, shape
from sessionloom.plans import stand_ins as v
from sessionloom.plans.features import DESCRIBED, correlation_sql, describe_sql

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SHARE_COLS = ["o_orderstatus", "o_orderpriority"]
CHUNKS = 13
SAMPLE_SEED = 11


def describe_numeric(spark, sf):
    return profile.describe(v.gappy_lines(spark, sf), MEASURES)


def missing_counts(spark, sf):
    return profile.missing_counts(v.gappy_lines(spark, sf))


def sparsity_profile(spark, sf):
    return profile.sparsity_profile(v.gappy_lines(spark, sf), MEASURES)


def schema_profile(spark, sf):
    return shape.schema_profile(v.gappy_lines(spark, sf))


def correlation_matrix(spark, sf):
    return profile.correlation_matrix(v.gappy_lines(spark, sf), MEASURES)


def snapshot_correlation(spark, sf):
    return profile.correlation_matrix(v.sessions(spark, sf), [*v.ACTIVITY, *v.ATTRIBUTES])


def value_shares(spark, sf):
    return profile.value_shares(v.table(spark, sf, "orders"), SHARE_COLS)


def unique_entity_shares(spark, sf):
    """Value shares over one row per customer, the earliest order."""
    return profile.value_shares(first_per_entity(spark, sf), SHARE_COLS)


def session_sparsity(spark, sf):
    return profile.sparsity_profile(v.sessions(spark, sf), v.ACTIVITY)


def attribute_variability(spark, sf):
    return profile.attribute_variability(v.table(spark, sf, "orders"), ["o_custkey"], SHARE_COLS)


def incomplete_entities(spark, sf):
    last = v.event_days(spark, sf).groupBy("id_student").agg(F.max("date").alias("last_day"))
    return profile.incomplete_entities(
        v.students(spark, sf).join(last, "id_student", "left"), ["code_module", "region", "last_day"]
    )


def first_per_entity(spark, sf):
    return ranking.first_per_key(v.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def contingency_dense(spark, sf):
    return profile.contingency(
        v.clicks(spark, sf), "code_module", v.MODULES, "code_presentation", v.PRESENTATIONS
    )


def session_contingency(spark, sf):
    return profile.contingency(
        v.sessions(spark, sf), "code_module", v.MODULES, "code_presentation", v.PRESENTATIONS
    )


def stacked_counts(spark, sf):
    return profile.stacked_counts(v.students(spark, sf), "region", "final_result", [0, 1, 2, 3])


def grouped_counts(spark, sf):
    return (
        v.students(spark, sf)
        .groupBy("region", "code_module")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("region", "code_module")
    )


def distinct_tuples(spark, sf):
    seen = v.event_days(spark, sf).select("id_student", "code_presentation").distinct()
    return joins.left_merge(seen, v.students(spark, sf).select("id_student", "code_module")).select(*v.SESSION).distinct()


def distinct_days(spark, sf):
    return profile.distinct_count(v.event_days(spark, sf), ["id_student"], "date", "active_days")


def chunked_sort(spark, sf):
    return ranking.with_chunk(grouped_counts(spark, sf), ["region", "code_module"], CHUNKS)


def numbered_orders(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ranking.with_row_number(orders, ["o_totalprice", "o_orderkey"], ["o_orderstatus"])


def head_rows(spark, sf):
    return ranking.head_rows(v.table(spark, sf, "orders"), ["o_orderkey"], 5)


def sample_rows(spark, sf):
    return ranking.sample_rows(v.table(spark, sf, "orders"), "o_orderkey", 3, SAMPLE_SEED)


def quantile_table(spark, sf):
    marks = quantiles.exact_quantiles(v.gappy_lines(spark, sf), MEASURES, [0.05, 0.75, 0.95, 0.98])
    return marks.withColumn("quantile", F.round("quantile", 6))


def quantile_by_class(spark, sf):
    marks = quantiles.exact_quantiles(
        v.table(spark, sf, "orders"), ["o_totalprice"], [0.75, 0.98], ["o_orderstatus"]
    )
    return marks.withColumn("quantile", F.round("quantile", 6))


def quantile_trim(spark, sf):
    return quantiles.trim(v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.98)


def quantile_trim_class(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return quantiles.trim_within(orders, "o_totalprice", 0.98, ["o_orderstatus"])


def quantile_trim_small(spark, sf):
    """The trim on a column of tiny values; the 0.985 quantile falls between two orders."""
    orders = v.table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 1e-12).alias("tiny"))
    return quantiles.trim(orders, "tiny", 0.985).select("o_orderkey")


def quantile_band(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return quantiles.band(orders, "o_totalprice", 0.05, 0.95)


REFINED = ["tail", "hot", "tiny"]
REFINED_PROBS = [0.01, 0.25, 0.5, 0.9, 0.999]


def quantile_refined(spark, sf):
    """A heavy tail, a value on a third of the rows and values near zero, refined in many narrow steps."""
    x = F.col("l_extendedprice")
    shapes = v.table(spark, sf, "lineitem").select(
        (x / 1000 * (x / 1000) * (x / 1000)).alias("tail"),
        F.when(F.col("l_returnflag") == "N", F.lit(5.0)).otherwise(x).alias("hot"),
        (x * 1e-9).alias("tiny"),
    )
    marks = quantiles.exact_quantiles(shapes, REFINED, REFINED_PROBS, accuracy=32)
    fine = F.when(F.col("feature") == "tiny", F.round("quantile", 12)).otherwise(F.round("quantile", 4))
    return marks.withColumn("quantile", fine)


def _wide_columns() -> dict[str, tuple[str, int, int]]:
    """Twenty columns from the four measures: ``measure + k * l_linenumber``, missing on every (k + 5)th order."""
    return {f"{m}_{k}": (m, k, k + 5) for k in range(5) for m in MEASURES}


def correlation_wide(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        *[
            F.when(F.col("l_orderkey") % every != 0, F.col(m) + F.col("l_linenumber") * k).alias(name)
            for name, (m, k, every) in _wide_columns().items()
        ]
    )
    return profile.correlation_matrix(lines, list(_wide_columns()))


LISTED_MODULES, LISTED_PRESENTATIONS = v.MODULES[:3], v.PRESENTATIONS[1:]


def contingency_loss(spark, sf):
    return profile.contingency_loss(
        v.clicks(spark, sf), "code_module", LISTED_MODULES, "code_presentation", LISTED_PRESENTATIONS
    )


def stacked_other(spark, sf):
    """The stacked counts with two of the four results listed."""
    return profile.stacked_counts(v.students(spark, sf), "region", "final_result", [0, 1], "n_other")


QUERIES = {
    f.__name__: f
    for f in (
        v.display(correlation_wide, {"r": 6}),
        quantile_refined, contingency_loss, stacked_other,
        v.display(describe_numeric, DESCRIBED, even=True),
        *[v.display(q, {"zero_share_of_rows": 6}) for q in (sparsity_profile, session_sparsity)],
        *[v.display(q, {"r": 6}) for q in (correlation_matrix, snapshot_correlation)],
        *[v.display(q, {"share": 6}) for q in (value_shares, unique_entity_shares)],
        v.display(attribute_variability, {"mean_distinct": 6}),
        missing_counts, schema_profile, incomplete_entities, first_per_entity, quantile_trim_small,
        contingency_dense, session_contingency, stacked_counts, grouped_counts, distinct_tuples,
        distinct_days, chunked_sort, numbered_orders, head_rows, sample_rows, quantile_table,
        quantile_by_class, quantile_trim, quantile_trim_class, quantile_band,
    )
}

_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _sparsity_sql(source: str, cols: list[str]) -> str:
    return f"WITH src AS ({source}) " + _union(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} = 0) AS zero,
count(*) FILTER (WHERE {c} <> 0) AS nonzero, count(*) FILTER (WHERE {c} <> 0 OR {c} IS NULL) AS nonzero_or_null,
count({c}) AS non_null,
round_even(count(*) FILTER (WHERE {c} = 0) * 100.0::DOUBLE / count({c}), 2) AS pct_zero,
round_even(count(*) FILTER (WHERE {c} <> 0 OR {c} IS NULL) * 100.0::DOUBLE / count({c}), 2) AS pct_nonzero,
round(count(*) FILTER (WHERE {c} = 0) / count(*), 6) AS zero_share_of_rows FROM src"""
        for c in cols
    )


def _shares_sql(source: str) -> str:
    return f"WITH src AS ({source}) " + _union(
        f"SELECT '{c}' AS variable, {c} AS value, count(*) AS n, "
        f"round(count(*) / (SELECT count({c}) FROM src), 6) AS share FROM src WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in SHARE_COLS
    )


def _contingency_sql(source: str) -> str:
    mods = ", ".join(f"('{m}')" for m in v.MODULES)
    pres = ", ".join(f"({p})" for p in v.PRESENTATIONS)
    return f"""
SELECT m.code_module, p.code_presentation, count(s.id_student) AS n
FROM (VALUES {mods}) m(code_module), (VALUES {pres}) p(code_presentation)
LEFT JOIN ({source}) s ON s.code_module = m.code_module AND s.code_presentation = p.code_presentation
GROUP BY ALL"""


_FIRST = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1"""
_COUNTS = f"SELECT region, code_module, count(*) AS n FROM ({v.STUDENTS}) GROUP BY region, code_module"

_WIDE = "SELECT " + ", ".join(
    f"CASE WHEN l_orderkey % {every} <> 0 THEN {m} + l_linenumber * {k} END AS {name}"
    for name, (m, k, every) in _wide_columns().items()
) + " FROM lineitem"
_TAIL = "l_extendedprice / 1000"
_SHAPES = f"""
SELECT {_TAIL} * ({_TAIL}) * ({_TAIL}) AS tail, CASE WHEN l_returnflag = 'N' THEN 5.0::DOUBLE ELSE l_extendedprice END AS hot,
       l_extendedprice * 1e-9::DOUBLE AS tiny FROM lineitem"""
_IN_MODULES = ", ".join(f"'{m}'" for m in LISTED_MODULES)
_IN_TERMS = ", ".join(map(str, LISTED_PRESENTATIONS))

ORACLE = {
    "quantile_refined": f"WITH src AS MATERIALIZED ({_SHAPES}) " + _union(
        f"SELECT '{c}' AS feature, {q}::DOUBLE AS prob, round(quantile_cont({c}, {q}), {12 if c == 'tiny' else 4}) AS quantile FROM src"
        for c in REFINED for q in REFINED_PROBS
    ),
    "correlation_wide": correlation_sql(_WIDE, list(_wide_columns())),
    "contingency_loss": f"""
SELECT count(*) AS total,
       count(*) FILTER (WHERE code_module IN ({_IN_MODULES}) AND code_presentation IN ({_IN_TERMS})) AS listed,
       count(*) FILTER (WHERE code_module NOT IN ({_IN_MODULES}) OR code_presentation NOT IN ({_IN_TERMS})) AS unlisted,
       count(*) FILTER (WHERE code_module IS NULL OR code_presentation IS NULL) AS no_value
FROM ({v.CLICKS})""",
    "stacked_other": f"""
SELECT region, count(*) FILTER (WHERE final_result = 0) AS n_0, count(*) FILTER (WHERE final_result = 1) AS n_1,
       count(*) FILTER (WHERE final_result NOT IN (0, 1) OR final_result IS NULL) AS n_other
FROM ({v.STUDENTS}) GROUP BY region""",
    "describe_numeric": describe_sql(v.GAPPY_LINES, MEASURES),
    "missing_counts": f"WITH src AS ({v.GAPPY_LINES}) " + _union(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM src" for c in _LINE_TYPES
    ),
    "sparsity_profile": _sparsity_sql(v.GAPPY_LINES, MEASURES),
    "session_sparsity": _sparsity_sql(v.SESSIONS, v.ACTIVITY),
    "schema_profile": f"WITH src AS ({v.GAPPY_LINES}) " + _union(
        f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS type_name, count(*) AS row_count, "
        f"count({c}) AS non_null FROM src"
        for i, (c, t) in enumerate(_LINE_TYPES.items())
    ),
    "correlation_matrix": correlation_sql(v.GAPPY_LINES, MEASURES),
    "snapshot_correlation": correlation_sql(v.SESSIONS, [*v.ACTIVITY, *v.ATTRIBUTES]),
    "value_shares": _shares_sql("SELECT * FROM orders"),
    "unique_entity_shares": _shares_sql(_FIRST),
    "attribute_variability": _union(
        f"SELECT '{c}' AS variable, count(*) AS entities, round(avg(n), 6) AS mean_distinct "
        f"FROM (SELECT count(DISTINCT {c}) AS n FROM orders GROUP BY o_custkey) WHERE n > 0"
        for c in SHARE_COLS
    ),
    "incomplete_entities": f"""
SELECT count(*) AS entities,
       count(*) FILTER (WHERE code_module IS NULL OR region IS NULL OR last_day IS NULL) AS incomplete,
       count(*) FILTER (WHERE code_module IS NOT NULL AND region IS NOT NULL AND last_day IS NOT NULL) AS complete
FROM ({v.STUDENTS}) LEFT JOIN (SELECT id_student, max(date) AS last_day FROM ({v.EVENT_DAYS}) GROUP BY 1) USING (id_student)""",
    "first_per_entity": _FIRST,
    "contingency_dense": _contingency_sql(v.CLICKS),
    "session_contingency": _contingency_sql(v.SESSIONS),
    "stacked_counts": f"""
SELECT region, {', '.join(f'count(*) FILTER (WHERE final_result = {i}) AS n_{i}' for i in range(4))}
FROM ({v.STUDENTS}) GROUP BY region""",
    "grouped_counts": _COUNTS,
    "distinct_tuples": f"SELECT DISTINCT id_student, code_module, code_presentation FROM ({v.CLICKS})",
    "distinct_days": f"SELECT id_student, count(DISTINCT date) AS active_days FROM ({v.EVENT_DAYS}) GROUP BY 1",
    "chunked_sort": f"""
SELECT *, CAST(ntile({CHUNKS}) OVER (ORDER BY region, code_module) - 1 AS INTEGER) AS chunk FROM ({_COUNTS})""",
    "numbered_orders": """
SELECT o_orderkey, o_orderstatus, o_totalprice,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS row_number,
       count(*) OVER (PARTITION BY o_orderstatus) AS group_rows FROM orders""",
    "head_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "sample_rows": f"SELECT * FROM orders ORDER BY md5('{SAMPLE_SEED}:' || o_orderkey), o_orderkey LIMIT 3",
    "quantile_table": f"WITH src AS ({v.GAPPY_LINES}) " + _union(
        f"SELECT '{c}' AS feature, CAST({q} AS DOUBLE) AS prob, "
        f"round(quantile_cont({c}, {q}), 6) AS quantile FROM src"
        for c in MEASURES for q in (0.05, 0.75, 0.95, 0.98)
    ),
    "quantile_by_class": _union(
        f"SELECT o_orderstatus, 'o_totalprice' AS feature, CAST({q} AS DOUBLE) AS prob, "
        f"round(quantile_cont(o_totalprice, {q}), 6) AS quantile FROM orders GROUP BY o_orderstatus"
        for q in (0.75, 0.98)
    ),
    "quantile_trim": """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.98) FROM orders)""",
    "quantile_trim_small": """
WITH src AS (SELECT o_orderkey, o_totalprice * 1e-12::DOUBLE AS tiny FROM orders)
SELECT o_orderkey FROM src WHERE tiny <= (SELECT quantile_cont(tiny, 0.985) FROM src)""",
    "quantile_trim_class": """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders JOIN (
  SELECT o_orderstatus, quantile_cont(o_totalprice, 0.98) AS lim FROM orders GROUP BY 1) USING (o_orderstatus)
WHERE o_totalprice <= lim""",
    "quantile_band": """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.05) FROM orders)
  AND o_totalprice < (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)""",
}
