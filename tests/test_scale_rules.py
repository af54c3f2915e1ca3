"""Large values, null segments, tree bins, slices and the checkpoint folder."""

import statistics

import pytest
from pyspark.sql import functions as F

from conftest import F_, GOLDEN_PARAMS, M, SF, UK, make_txn
from vintage.operators import cells as C
from vintage.operators import customers as CU
from vintage.operators import impute as IM
from vintage.operators import matrix as MX
from vintage.operators import profile as PR
from vintage.operators import ranking, trees
from vintage.params import Params, months_between
from vintage.session import ensure_checkpoint_dir
from vintage.sources import transactions_from_tables


def test_describe_of_large_quantities(spark):
    rows = [(f"t{i}", "c1", "2010-01-05", "2010-01-01", 10 ** 14 + i, M, F_, UK, q, "i1")
            for i, q in enumerate([80_995, -80_995, 74_215, 2_000_000_000, -2_000_000_000])]
    got = {r["column"]: r for r in PR.describe(make_txn(spark, rows)).collect()}
    q = [80_995, -80_995, 74_215, 2_000_000_000, -2_000_000_000]
    assert got["quantity"]["std"] == pytest.approx(statistics.stdev(q))
    assert got["transaction_amount"]["std"] == pytest.approx(statistics.stdev(range(5)))


def test_null_segments_leave_every_operator(spark):
    p = GOLDEN_PARAMS.with_(country=None, segment_cols=("country",))
    rows = []
    for i in range(90):
        month = 1 + i % 6
        rows.append((f"t{i}", f"c{i % 11}", f"2010-{month:02d}-05", "2010-01-01", 10 + i, M, F_,
                     [UK, "France", None][i % 3], 1, f"i{i % 4}"))
    txn = make_txn(spark, rows)
    known = txn.where("country is not null")
    for f in (lambda t: C.cohort_cells(t, p), lambda t: CU.customer_profile(t, C.cohort_cells(t, p), p),
              lambda t: MX.observed(C.cohort_cells(t, p), "retention_rate_pc", p),
              lambda t: IM.knn_filled(C.cohort_cells(t, p), "retention", p)):
        got, want = (sorted(map(str, f(t).collect())) for t in (txn, known))
        assert got and all("country=None" not in r for r in got)
        if f(txn).columns != f(known).columns or len(got) != len(want):
            raise AssertionError((len(got), len(want)))
    cells = C.cohort_cells(txn, p)
    assert cells.where("total_transactions is null").count() == 0
    segments = CU.segments(cells, CU.cohort_customers(txn, cells, p), p)
    assert segments.where("country is null").count() == 0


def test_trees_can_split_late_periods(spark):
    """A matrix of 200 periods whose values change at period 171 only."""
    m = spark.range(2).crossJoin(spark.range(200).withColumnRenamed("id", "c")).select(
        F.col("id").cast("int").alias("row_idx"), F.col("c").cast("int").alias("col_idx"),
        F.when(F.col("c") >= 171, 10.0).otherwise(1.0).alias("value"), F.lit(False).alias("is_query"))
    asked = m.withColumn("row_idx", F.col("row_idx") + 2).withColumn("is_query", F.lit(True)).withColumn("value", F.lit(None).cast("double"))
    rows = trees.predictions(m.unionByName(asked), [], 1, 25, 1).where("row_idx = 3 and model = 'Random Forest'").collect()
    got = {r.col_idx: r.prediction for r in rows}
    assert got[165] == pytest.approx(1.0, abs=0.5) and got[175] == pytest.approx(10.0, abs=0.5) and len(got) == 200


def test_trees_keep_segments_apart(spark):
    """Two segments with opposite matrices."""
    m = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("country"), F.floor(F.col("id") % 20 / 2).cast("int").alias("row_idx"),
        F.floor(F.col("id") / 20).cast("int").alias("col_idx"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(-5.0).alias("value"),
        (F.col("id") % 7 == 0).alias("is_query"))
    rows = trees.predictions(m, ["country"], 1, 5, 1).collect()
    assert rows and all(r.prediction == pytest.approx(5.0 if r.country == "a" else -5.0, abs=1e-9) for r in rows)


def test_pivot_columns_are_those_asked_for(spark, golden):
    cells = C.cohort_cells(golden, GOLDEN_PARAMS)
    piv = MX.pivot(cells, "retention_rate_pc", GOLDEN_PARAMS, [0, 2, 9])
    assert piv.columns == ["cohort", "0", "2", "9"]
    assert MX.pivot_t(cells, "retention_rate_pc", GOLDEN_PARAMS, ["2010-01"]).columns == ["period_number", "2010-01"]
    assert months_between("1999-11-01", "2000-02") == ["1999-11", "1999-12", "2000-01", "2000-02"]


def test_slices_follow_the_input(spark, monkeypatch):
    df = transactions_from_tables(spark, SF)
    assert ranking._default_slices(df) == 8
    monkeypatch.setattr(ranking, "SLICE_BYTES", 10_000)
    assert ranking._default_slices(df) > 8


def test_row_numbers_need_one_range_exchange(spark, golden):
    df = ranking.row_number_within(golden.where("customer_id is not null"), ["customer_id"], ["transaction_id", "transaction_item_code"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1  # over the slices' totals only


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, master):
        self.sparkContext = _Context(master)
        self.conf = self

    def get(self, key, default=None):
        return default


def test_no_local_checkpoint_folder_on_a_cluster():
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(_Session(master))
