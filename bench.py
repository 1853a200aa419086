"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or ``all``
for every query of the library outside ``llm``), BENCH_WARM (default 1). Each query is built, planned and
run to the end into the ``noop`` sink; jobs it starts while being built count too. With BENCH_WARM=1 it
runs once untimed on the sf0.001 tables next to the measured ones, so the figure is not JVM class loading.
"""

from __future__ import annotations

import json
import os
import time

from sessionloom.plans.catalog import QUERIES
from sessionloom.session import local_session

HEADLINE = [
    "session_daily_pivot", "session_snapshot", "total_interactions", "activity_assessment_merge",
    "consolidated_final", "many_to_many_merge", "fact_dim_left_merge", "join_invariants", "week_index",
    "gap_cv", "weekly_consistency", "regularity_correlation", "describe_numeric", "sparsity_profile",
    "correlation_matrix", "value_shares", "attribute_variability", "first_per_entity",
    "contingency_dense", "numbered_orders", "quantile_table", "quantile_trim", "hist_multi_feature",
    "hist_by_class", "hist_trimmed_class", "hist_trimmed_facets", "hist_2d", "density_curve",
    "pair_bins", "score_coverage", "last_day_scored", "partition_roundtrip", "csv_roundtrip",
    "standardize", "majority_baseline", "stratified_folds", "logistic_holdout",
]


def run(spark, name: str, sf_dir: str) -> None:
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = sorted(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = os.environ.get("BENCH_WARM", "1") == "1" and os.path.isdir(small)
    times: dict[str, float] = {}
    for name in names:
        if warm:
            run(spark, name, small)
        start = time.perf_counter()
        run(spark, name, sf_dir)
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "warm": warm,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
