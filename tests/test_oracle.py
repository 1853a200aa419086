"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, duck
from sessionloom.plans import catalog

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE
SLOW = {"logistic_holdout", "forest_holdout", "snapshot_holdout", "model_cv"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == ""


def test_only_models_lack_sql():
    assert set(QUERIES) - set(ORACLE) == SLOW
    assert set(ORACLE) <= set(QUERIES)


def test_entry_offers_all():
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLE.items() <= entry_module.oracle_sql().items()


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.columns[:1] == ["id_student"]
