"""Labels print as Python prints them, ties and infinities included."""

import math
import random

from pyspark.sql import functions as F

from vintage.functions import fixed, general


def test_fixed_equals_python(spark):
    random.seed(1)
    values = [k / 1000 for k in range(-2500, 2500)] + [k + d for k in (0, 1, 2, 7, 12345) for d in (0.005, 0.015, 0.085, 0.125, 0.25, 0.45)]
    values += [random.uniform(-1e6, 1e6) for _ in range(1500)] + [random.uniform(-1, 1) * 10 ** random.randint(-12, 15) for _ in range(1500)]
    values += [0.0, -0.004, 1e15 + 0.5, float("inf"), float("-inf"), 0.5, 1.5, 2.5]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for places in (0, 1, 2):
        rows = df.select("v", fixed("v", places).alias("t")).collect()
        bad = [(r.v, r.t, f"{r.v:.{places}f}") for r in rows if r.t != f"{r.v:.{places}f}"]
        assert not bad, bad[:5]


def test_general_equals_python(spark):
    values = [0.0, 1.0, 12.5, 123.0, 99999.9, 99999.0, 123456.7, 123456.5, 999999.0, 999999.4, 999999.9, 1000005.0, 1000015.0, 1234567.0, 99999950.0,
              12345678901.0, float("inf"), -250.5, -1234567.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", general("v").alias("t")).collect()
    bad = [(r.v, r.t, f"{r.v:g}") for r in rows if r.t != f"{r.v:g}"]
    assert not bad, bad


def test_float_text_of_counts_and_ltvs(spark):
    values = [0.0, 3.0, 1250.0, 17.3, -4.5, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed("v", 1).alias("t")).collect()
    assert all(r.t == str(r.v) for r in rows) and not any(math.isnan(r.v) for r in rows)
    assert spark.range(1).select(fixed(F.lit(None).cast("double"), 2).alias("t")).first().t is None
