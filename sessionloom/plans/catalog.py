"""All registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.plans import (
    attributes,
    baselines,
    distributions,
    features,
    flat,
    merges,
    profiles,
    quality,
    round_trips,
    star,
)

_MODULES = (merges, features, profiles, distributions, quality, round_trips, baselines, star, attributes, flat)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for module in _MODULES for name, query in module.QUERIES.items()
}
ORACLE: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
