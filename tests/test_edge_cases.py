"""FIXTURES.md §5: cases the driver tables do not produce."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import GOLDEN_PARAMS as P, M, F_, UK, make_txn
from vintage.functions import rnd
from vintage.operators import cells as C
from vintage.operators import customers as CU
from vintage.operators import matrix as MX
from vintage.operators.quantiles import exact_quantiles


def test_numpy_rounding(spark):
    df = spark.createDataFrame([(0.285,), (1.005,), (2.675,), (0.25,), (0.35,), (0.45,), (1.15,)], "x double")
    got = df.select(rnd("x", 2).alias("r2"), rnd("x", 1).alias("r1")).collect()
    assert [r.r2 for r in got[:3]] == [0.28, 1.0, 2.68]
    assert [r.r1 for r in got[3:]] == [0.2, 0.4, 0.4, 1.2]
    xs = [0.285, 1.005, 2.675, 0.25, 0.35, 0.45, 1.15]
    assert [r.r2 for r in got] == list(np.round(xs, 2))
    assert [r.r1 for r in got] == list(np.round(xs, 1))


def test_quantiles_fixture(spark):
    df = spark.createDataFrame([(1.1,), (2.7,), (3.9,), (10.2,), (None,)], "x double")
    q = exact_quantiles(df, "x", [0.5, 0.8]).first()
    exp = pd.Series([1.1, 2.7, 3.9, 10.2, None]).quantile([0.5, 0.8]).tolist()
    assert [q.q50, q.q80] == exp
    assert abs(q.q50 - 3.3) < 1e-12 and abs(q.q80 - 6.42) < 1e-12


def test_quantiles_random_against_pandas(spark):
    rng = np.random.default_rng(7)
    for _ in range(4):
        vals = list(np.round(rng.normal(0, 100, rng.integers(1, 60)), 1))
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        got = list(exact_quantiles(df, "x", [0.25, 0.5, 0.75, 0.8]).first())
        assert got == pd.Series(vals).quantile([0.25, 0.5, 0.75, 0.8]).tolist()


def test_grouped_quantiles(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4]] + [("b", float(v)) for v in [10, 30]] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q50 for r in exact_quantiles(df, "x", [0.5], group_cols=("g",)).collect()}
    assert got == {"a": 2.5, "b": 20.0}


def test_infinite_ltv(spark):
    # cohort 2010-05: 25 rows at period 0, 26 at period 1 -> retention 104 at period 1
    rows = []
    for i in range(25):
        rows.append((f"a{i}", f"k{i}", "2010-05-03", "2010-05-01", 10, M, F_, UK, 1, "i1"))
    for i in range(26):
        rows.append((f"b{i}", f"k{i % 25}", "2010-06-03", "2010-05-01", 10, M, F_, UK, 1, "i1"))
    txn = make_txn(spark, rows)
    cells = {r.period_number: r for r in C.cohort_cells(txn, P).collect()}
    assert cells[1].retention_rate_pc == 104.0
    assert cells[0].retention_rate_for_cltv == 104.0
    assert cells[0].traditional_ltv == math.inf
    # +inf is a value, not a missing one: it enters quantiles and maxima
    cc = CU.cohort_customers(txn, C.cohort_cells(txn, P), P)
    assert CU.customer_ltv(cc, P).agg(F.max("traditional_ltv")).first()[0] == math.inf


def test_null_item_key_absent_from_profile_but_counted(spark, golden):
    rows = [("z1", "c9", "2010-01-07", "2010-01-01", 20, M, F_, UK, 1, None)]
    txn = golden.unionByName(make_txn(spark, rows))
    prof = CU.profile_agg(txn, P)
    assert prof.where(F.col("customer_id") == "c9").count() == 0
    purch = C.purchases(txn, P).where(F.col("txn_month") == dt.date(2010, 1, 1)).first()
    assert (purch.total_transactions, purch.total_customers) == (5, 4)


def test_negative_period_first_pivot_column(spark, golden):
    rows = [("n1", "c1", "2009-12-20", "2010-01-01", 5, M, F_, UK, 1, "i1")]
    txn = golden.unionByName(make_txn(spark, rows))
    cells = C.cohort_cells(txn, P)
    periods = sorted(r.period_number for r in cells.where(F.col("cohort") == dt.date(2010, 1, 1)).collect())
    assert periods[0] == -1
    piv = MX.pivot(cells, "no_of_customers", P)
    assert "-1" in piv.columns
    size = {r.cohort: r.cohort_size for r in MX.cohort_size(cells, "no_of_customers", P).collect()}
    assert size["2010-01"] == 1  # value at period -1, the first pivot column


def test_partition_independence(spark, golden):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return sorted(map(tuple, C.cohort_cells(golden.repartition(n), P).collect()), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert run(1) == run(16)


def test_segmented_segments_use_their_own_thresholds(spark, golden):
    from vintage.operators.quantiles import exact_quantiles
    p = P.with_(country=None, segment_cols=("country",))
    cells = C.cohort_cells(golden, p)
    cc = CU.cohort_customers(golden, cells, p)
    got = CU.segments(cells, cc, p).collect()
    assert {r.country for r in got} <= {"United Kingdom", "France"}
    for country in {r.country for r in got}:
        c_cells = cells.where(F.col("country") == country)
        cust = CU.customer_ltv(cc, p).where(F.col("country") == country)
        qc = exact_quantiles(c_cells, "traditional_ltv", [0.5, 0.8]).first()
        qk = exact_quantiles(cust, "traditional_ltv", [0.5, 0.8]).first()
        for r in (x for x in got if x.country == country):
            v = r.traditional_ltv
            exp = ("low_cltv" if v < qc.q50 else "medium_cltv" if qk.q50 <= v < qk.q80
                   else "high_cltv" if v >= qc.q80 else "unknown")
            assert r.traditional_ltv_segments == exp
