"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

from vintage.plans.catalog import REGISTRY

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_flagship(spark):
    e = _entry()
    df = e.entry(spark)
    assert df.columns[:3] == ["cohort", "txn_month", "period_number"]
    assert df.count() == 453  # FIXTURES.md §3, sf 0.001 cells


def test_queries_and_oracle_keys():
    e = _entry()
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70
    own = {k for k in q if k in REGISTRY}
    trees = ("best_filled", "model_predictions", "model_scores", "random_search")  # against plain-Python trees in test_trees.py
    assert {k.rsplit("_", 1)[0].removesuffix("_by") for k in own - set(o)} == set(trees) and len(own - set(o)) == 10
    for name, sql in o.items():
        if name not in own:
            continue
        assert sql.lstrip().upper().startswith("WITH"), name
