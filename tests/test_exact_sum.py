"""Order-free sums: against fractions, against the SQL twin, in any order."""

import math
import random
from fractions import Fraction

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from vintage.functions import exact_sum
from vintage.plans.catalog import REGISTRY
from vintage.plans.sqlfrag import exact_sum as exact_sum_sql


def values():
    rng = random.Random(6)
    return {"squares": [rng.random() ** 2 * 10 ** rng.randrange(-6, 6) for _ in range(800)],
            "signs": [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-3, 12) for _ in range(801)],
            "cancel": [1e16, 1.0, -1e16, 2.0 ** -30, 3.5], "one": [-0.1], "inf": [1.0, math.inf, 2.0], "both": [math.inf, -math.inf],
            "zero": [0.0, -0.0], "tiny": [2.0 ** -70] * 5}


def test_sums_are_exact_and_order_free(spark):
    rows = [(k, x) for k, xs in values().items() for x in xs] + [("one", None), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double")
    found = [{r.k: r.s for r in df.repartition(n).groupBy("k").agg(exact_sum("x").alias("s")).collect()} for n in (1, 7)]
    assert str(found[0]) == str({k: found[1][k] for k in found[0]})
    for k, xs in values().items():
        if all(map(math.isfinite, xs)):
            want = float(sum(map(Fraction, xs)))
            assert found[0][k] == pytest.approx(want, rel=1e-15, abs=2.0 ** -78 * len(xs)), k
    assert found[0]["inf"] == math.inf and math.isnan(found[0]["both"]) and found[0]["none"] is None


def test_sql_twin(spark):
    for k, xs in values().items():
        if k == "both":
            continue
        ours = spark.createDataFrame([(x,) for x in xs], "x double").agg(exact_sum("x")).first()[0]
        con = duckdb.connect()
        con.execute("CREATE TABLE t (x DOUBLE)")
        con.executemany("INSERT INTO t VALUES (?)", [[x] for x in xs])
        assert con.execute(f"SELECT {exact_sum_sql('x')} FROM t").fetchone()[0] == ours, k


def test_r2_holds_no_array_of_terms(spark):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        REGISTRY["knn_r2_retention"][0](spark, SF).explain("formatted")
    assert "collect_list" not in buf.getvalue()
