"""Queries: histograms, density, pair counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.operators import features, histograms, shape
from sessionloom.plans import stand_ins as v

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SIZE_EDGES = [float(e) for e in range(0, 51, 5)]
QUANTITY_EDGES = [float(e) for e in range(0, 51, 10)]
DISCOUNT_EDGES = [-0.005, 0.025, 0.055, 0.085, 0.105]


def hist_fixed_edges(spark, sf):
    return histograms.histogram_edges(v.table(spark, sf, "part"), "p_size", SIZE_EDGES)


def hist_equal_bins(spark, sf):
    return histograms.histograms(v.table(spark, sf, "orders"), ["o_totalprice"], 30)


def hist_multi_feature(spark, sf):
    return histograms.histograms(v.table(spark, sf, "lineitem"), FEATURES, 10)


def session_histograms(spark, sf):
    return histograms.histograms(v.stored_sessions(spark, sf), v.ACTIVITY, 20, nonzero_only=True)


def hist_nonzero(spark, sf):
    return histograms.histograms(v.table(spark, sf, "lineitem"), FEATURES, 20, nonzero_only=True)


def hist_2d(spark, sf):
    return histograms.histogram_2d(
        v.table(spark, sf, "lineitem"), "l_quantity", QUANTITY_EDGES, "l_discount", DISCOUNT_EDGES
    )


def hist_by_class(spark, sf):
    return histograms.histograms(v.table(spark, sf, "orders"), ["o_totalprice"], 10, ["o_orderstatus"])


def hist_trimmed_class(spark, sf):
    return histograms.trimmed_histograms(v.table(spark, sf, "orders"), "o_totalprice", 0.98, ["o_orderstatus"])


def hist_tail_common(spark, sf):
    return histograms.tail_histogram(v.table(spark, sf, "orders"), "o_totalprice", 0.75, "o_orderstatus")


def hist_trimmed_facets(spark, sf):
    return histograms.trimmed_histograms(
        v.stored_sessions(spark, sf), "view", 0.95, ["code_module", "code_presentation"]
    )


def hist_days_by_presentation(spark, sf):
    return histograms.histograms(v.event_days(spark, sf), ["date"], 10, ["code_presentation"])


def day_range_by_group(spark, sf):
    return histograms.day_ranges(v.event_days(spark, sf), ["code_presentation"], "date")


def density_curve(spark, sf):
    totals = features.with_total(v.stored_sessions(spark, sf), v.ACTIVITY)
    return histograms.density_curve(totals, "total_interactions")


def pair_bins(spark, sf):
    return histograms.pair_bins(
        v.table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], ["l_quantity", "l_linenumber"], "l_returnflag", 10
    )


def fill_first_non_null(spark, sf):
    lines = v.gappy_lines(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return shape.first_non_null(lines, "l_discount", "l_tax")


def density_constant(spark, sf):
    parts = v.table(spark, sf, "part").withColumn("level", F.col("p_size") * 0 + 3)
    return histograms.density_curve(parts, "level")


def density_continuous(spark, sf):
    """The density of a column with about as many values as rows."""
    return histograms.density_curve(v.table(spark, sf, "lineitem"), "l_extendedprice")


def pair_bins_grid(spark, sf):
    """Both sides of every pair binned."""
    return histograms.pair_bins(
        v.table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], ["l_quantity", "l_discount"], "l_returnflag", 10, 8
    )


def scored_day_bins(spark, sf):
    """Days of all rows and of scored rows on common bins, per presentation."""
    return histograms.shared_bins(
        v.event_days(spark, sf), "date", {"n_scored": F.col("score").isNotNull()}, 10, ["code_presentation"]
    )


_BINNED = (
    scored_day_bins,
    hist_equal_bins, hist_multi_feature, session_histograms, hist_nonzero, hist_by_class, hist_trimmed_class,
    hist_tail_common, hist_trimmed_facets, hist_days_by_presentation,
)

QUERIES = {
    f.__name__: f
    for f in (
        *[v.display(q, {"bin_lo": 6, "bin_hi": 6}) for q in _BINNED],
        v.display(density_curve, {"x": 6, "density": 9}),
        v.display(density_continuous, {"x": 6, "density": 12}),
        pair_bins_grid,
        density_constant,
        hist_fixed_edges, hist_2d, day_range_by_group, pair_bins, fill_first_non_null,
    )
}


def _edges_case(value: str, edges: list[float]) -> str:
    last = len(edges) - 2
    whens = " ".join(
        f"WHEN {value} >= {lo}::DOUBLE AND {value} {'<=' if i == last else '<'} {hi}::DOUBLE THEN {i}"
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    )
    return f"CAST(CASE {whens} END AS INTEGER)"


def _long(table: str, cols: list[str], extra: str = "", where: str = "TRUE") -> str:
    more = f", {extra}" if extra else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value{more} FROM {table} WHERE {c} IS NOT NULL AND {where}"
        for c in cols
    )


def histogram_sql(source: str, bins: int, on: list[str], split: list[str] = []) -> str:
    """``source`` yields feature, value and the grouping columns."""
    on = [*on, "feature"]
    keys, all_keys = ", ".join(on), ", ".join([*on, *split])
    shown = f"(SELECT DISTINCT {all_keys} FROM src) JOIN r USING ({keys})" if split else "r"
    return f"""
WITH src AS ({source}),
r0 AS (SELECT {keys}, min(value) AS a, max(value) AS b FROM src GROUP BY ALL),
r AS (SELECT {keys}, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM r0),
c AS (SELECT {all_keys}, LEAST(CAST(floor((value - lo) * {bins}.0::DOUBLE / (hi - lo)) AS INTEGER), {bins - 1}) AS bin,
             count(*) AS n FROM src JOIN r USING ({keys}) GROUP BY ALL),
spine AS (SELECT {all_keys}, lo, hi, CAST(i AS INTEGER) AS bin FROM {shown}, range({bins}) t(i))
SELECT {all_keys}, bin, round(lo + bin * ((hi - lo) / {bins}.0::DOUBLE), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / {bins}.0::DOUBLE), 6) AS bin_hi, COALESCE(n, 0) AS n
FROM spine LEFT JOIN c USING ({all_keys}, bin)"""


def _density_sql(source: str, digits: int) -> str:
    return f"""
WITH src AS ({source}),
s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2::DOUBLE) AS h FROM src),
g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 99.0::DOUBLE AS gx, n, h FROM s, range(100) t(i))
SELECT point, round(gx, 6) AS x,
       round(sum(exp(-0.5::DOUBLE * pow((gx - x) / h, 2))) / (n * h * sqrt(2.0::DOUBLE * pi())), {digits}) AS density
FROM g, src GROUP BY point, gx, n, h"""


def _pair_grid_sql() -> str:
    bins = {"l_extendedprice": 10, "l_tax": 10, "l_quantity": 8, "l_discount": 8}
    edges = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in bins)
    at = ", ".join(
        f"LEAST(CAST(floor(({c} - {c}_lo) * {n}.0::DOUBLE / ({c}_hi - {c}_lo)) AS INTEGER), {n - 1}) AS {c}_bin" for c, n in bins.items()
    )
    cells = " UNION ALL ".join(
        f"SELECT '{x}' AS x_feature, '{y}' AS y_feature, l_returnflag, {x}_bin AS x_bin, {y}_bin AS y_bin FROM b"
        for x in ("l_extendedprice", "l_tax") for y in ("l_quantity", "l_discount")
    )
    return f"""
WITH e AS (SELECT {edges} FROM lineitem), b AS (SELECT l_returnflag, {at} FROM lineitem, e)
SELECT *, count(*) AS n FROM ({cells}) GROUP BY ALL"""


_SIZES = ", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (lo, hi) in enumerate(zip(SIZE_EDGES, SIZE_EDGES[1:])))
_TRIMMED = "o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.98) FROM orders)"
_TAIL = "o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.75) FROM orders)"
_TOTAL = " + ".join(v.ACTIVITY)

ORACLE = {
    "hist_fixed_edges": f"""
SELECT e.bin, e.bin_lo, e.bin_hi, count(p.p_partkey) AS n
FROM (VALUES {_SIZES}) e(bin, bin_lo, bin_hi)
LEFT JOIN part p ON {_edges_case('p.p_size', SIZE_EDGES)} = e.bin GROUP BY ALL""",
    "hist_equal_bins": histogram_sql(_long("orders", ["o_totalprice"]), 30, []),
    "hist_multi_feature": histogram_sql(_long("lineitem", FEATURES), 10, []),
    "hist_nonzero": histogram_sql(f"SELECT * FROM ({_long('lineitem', FEATURES)}) WHERE value > 0", 20, []),
    "session_histograms": histogram_sql(
        f"SELECT * FROM ({_long(f'({v.SESSIONS})', v.ACTIVITY)}) WHERE value > 0", 20, []
    ),
    "hist_2d": f"""
WITH c AS (SELECT {_edges_case('l_quantity', QUANTITY_EDGES)} AS x_bin, {_edges_case('l_discount', DISCOUNT_EDGES)} AS y_bin,
                  count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(x AS INTEGER) AS x_bin, CAST(y AS INTEGER) AS y_bin, COALESCE(n, 0) AS n
FROM range({len(QUANTITY_EDGES) - 1}) a(x), range({len(DISCOUNT_EDGES) - 1}) b(y)
LEFT JOIN c ON c.x_bin = x AND c.y_bin = y""",
    "hist_by_class": histogram_sql(_long("orders", ["o_totalprice"], "o_orderstatus"), 10, ["o_orderstatus"]),
    "hist_trimmed_class": histogram_sql(
        _long("orders", ["o_totalprice"], "o_orderstatus", _TRIMMED), 10, ["o_orderstatus"]
    ),
    "hist_tail_common": histogram_sql(
        _long("orders", ["o_totalprice"], "o_orderstatus", _TAIL), 50, [], ["o_orderstatus"]
    ),
    "hist_trimmed_facets": histogram_sql(
        f"""SELECT 'view' AS feature, CAST("view" AS DOUBLE) AS value, code_module, code_presentation FROM ({v.SESSIONS})
WHERE "view" <= (SELECT quantile_cont(CAST("view" AS DOUBLE), 0.95) FROM ({v.SESSIONS}))""",
        10,
        ["code_module", "code_presentation"],
    ),
    "hist_days_by_presentation": histogram_sql(
        _long(f"({v.EVENT_DAYS})", ["date"], "code_presentation"), 10, ["code_presentation"]
    ),
    "day_range_by_group": f"""
SELECT code_presentation, count(*) AS n, min(date) AS first_day, max(date) AS last_day
FROM ({v.EVENT_DAYS}) GROUP BY code_presentation""",
    "density_curve": _density_sql(f"SELECT CAST({_TOTAL} AS DOUBLE) AS x FROM ({v.SESSIONS})", 9),
    "density_continuous": _density_sql("SELECT l_extendedprice AS x FROM lineitem", 12),
    "pair_bins_grid": _pair_grid_sql(),
    "scored_day_bins": f"""
WITH src AS (SELECT code_presentation, CAST(date AS DOUBLE) AS value, score FROM ({v.EVENT_DAYS})),
r0 AS (SELECT code_presentation, min(value) AS a, max(value) AS b FROM src GROUP BY ALL),
r AS (SELECT code_presentation, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM r0),
c AS (SELECT code_presentation, LEAST(CAST(floor((value - lo) * 10.0::DOUBLE / (hi - lo)) AS INTEGER), 9) AS bin,
             count(*) AS n, count(score) AS n_scored FROM src JOIN r USING (code_presentation) GROUP BY ALL)
SELECT code_presentation, CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 10.0::DOUBLE), 6) AS bin_lo,
       round(lo + (i + 1) * ((hi - lo) / 10.0::DOUBLE), 6) AS bin_hi, COALESCE(n, 0) AS n, COALESCE(n_scored, 0) AS n_scored
FROM (SELECT * FROM r, range(10) t(i)) s LEFT JOIN c ON c.code_presentation = s.code_presentation AND c.bin = s.i""".replace(
        "SELECT code_presentation, CAST(i", "SELECT s.code_presentation, CAST(i"
    ),
    "density_constant": """
SELECT CAST(i AS INTEGER) AS point, 3.0::DOUBLE AS x, 1.0::DOUBLE AS density FROM range(100) t(i) WHERE EXISTS (FROM part)""",
    "pair_bins": """
WITH x AS (SELECT min(l_extendedprice) AS pl, max(l_extendedprice) AS ph, min(l_tax) AS tl, max(l_tax) AS th FROM lineitem),
b AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS q, CAST(l_linenumber AS DOUBLE) AS ln,
  LEAST(CAST(floor((l_extendedprice - pl) * 10.0::DOUBLE / (ph - pl)) AS INTEGER), 9) AS pb,
  LEAST(CAST(floor((l_tax - tl) * 10.0::DOUBLE / (th - tl)) AS INTEGER), 9) AS tb FROM lineitem, x),
u AS (SELECT 'l_extendedprice' AS x_feature, 'l_quantity' AS y_feature, l_returnflag, pb AS x_bin, q AS y FROM b
UNION ALL SELECT 'l_extendedprice', 'l_linenumber', l_returnflag, pb, ln FROM b
UNION ALL SELECT 'l_tax', 'l_quantity', l_returnflag, tb, q FROM b
UNION ALL SELECT 'l_tax', 'l_linenumber', l_returnflag, tb, ln FROM b)
SELECT x_feature, y_feature, l_returnflag, x_bin, y, count(*) AS n FROM u GROUP BY ALL""",
    "fill_first_non_null": f"""
SELECT l_orderkey, l_linenumber, COALESCE(l_discount, l_tax) AS l_discount FROM ({v.GAPPY_LINES})""",
}
