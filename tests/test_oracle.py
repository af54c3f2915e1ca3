"""Spark queries against their DuckDB oracle SQL on the smallest driver
tables (the driver repeats this at sf 0.01 for every query)."""

import pytest

from conftest import SF
from vintage.plans.catalog import REGISTRY
from vintage.plans.check import compare, duckdb_connection

SAMPLE = ["cohort_cells", "purchases", "describe", "unique_values", "customer_profile",
          "segments", "pivot_retention", "heatmap_ltv", "curve_ltv", "knn_filled_retention",
          "knn_r2_ltv"]


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    fn, sql = REGISTRY[name]
    res = compare(spark, SF, name, fn, sql(), con)
    assert res["status"] == "ok", res


def test_every_query_has_docstring_and_known_check():
    for name, (fn, sql) in REGISTRY.items():
        assert fn.__doc__, name
        if sql is None:
            assert name.startswith(("model_scores_", "model_predictions_", "random_search_", "best_filled_")), name
