"""Bucket refinement against numpy, bit for bit; describe in two passes."""

import contextlib
import io

import numpy as np
import pytest
from conftest import SF

from vintage.operators import quantiles as Q
from vintage.plans.catalog import REGISTRY

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


def columns():
    rng = np.random.default_rng(7)
    return {"normal": rng.normal(0, 1e6, 3000), "small": rng.normal(0, 1e-9, 501), "ties": rng.integers(-3, 4, 2000) / 4,
            "wide": np.exp(rng.normal(0, 40, 1000)) * rng.choice([-1, 1], 1000), "one": np.array([3.5]), "two": np.array([-1.0, 1e300]),
            "same bucket": 1e6 + rng.random(800), "hot": np.concatenate([np.full(5000, 2.25), rng.random(100)])}


def test_quantiles_equal_numpy(spark):
    rows = [(k, float(x)) for k, xs in columns().items() for x in xs] + [("normal", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in Q.refined_quantiles(df, Q.bucket_table(df, "v", ("g",)), "v", PROBS, NAMES, ("g",)).collect()}
    assert set(got) == set(columns())
    for k, xs in columns().items():
        assert [got[k][n] for n in NAMES] == [float(np.quantile(xs, p * 100.0 / 100.0)) for p in PROBS], k


def test_buckets_rise_with_the_value(spark):
    xs = sorted([*columns()["wide"], *columns()["small"], 0.0, -0.0, 1.0, 2.0, 4.0, 1e308, -1e308])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, v double")
    own = [r[0] for r in df.orderBy("i").select(Q.value_bucket(df.v)).collect()]
    assert own == sorted(own)


@pytest.mark.parametrize("rows", [[], [("a", None)]])
def test_nothing_gives_nothing(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    assert Q.refined_quantiles(df, Q.bucket_table(df, "v", ("g",)), "v", PROBS, NAMES, ("g",)).count() == 0


def test_describe_has_no_range_exchange(spark):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        REGISTRY["describe"][0](spark, SF).explain("formatted")
    assert "rangepartitioning" not in buf.getvalue() and "Scan ExistingRDD" in buf.getvalue()
