"""Plan-shape regressions: the properties the design relies on at scale."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import GOLDEN_PARAMS as P, M, F_, UK, SF, make_txn
from vintage.operators import cells as C
from vintage.operators import customers as CU
from vintage.plans.catalog import REGISTRY


def _plan(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_pushes_filters_and_has_no_customer_window(spark):
    df = REGISTRY["cohort_cells"][0](spark, SF)
    plan = _plan(df)
    scans = [b for b in plan.split("\n\n") if "lineitem.parquet" in b and "ReadSchema" in b]
    # each branch reads the lines once, and their keys once for the customers' first months
    assert 2 <= len(scans) <= 5
    for b in scans:
        columns = re.findall(r"(l_\w+):", b.split("ReadSchema")[1])
        assert columns and not {"l_shipdate", "l_tax", "l_comment", "l_suppkey"} & set(columns)
    assert any(set(re.findall(r"(l_\w+):", b.split("ReadSchema")[1])) == {"l_orderkey", "l_partkey"} for b in scans)
    # the scope filters act on the source columns, below the joins
    filters = [b for b in plan.split("\n\n") if ") Filter" in b.partition("\n")[0]]
    assert any("n_regionkey" in b for b in filters) and any("p_type" in b for b in filters)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
    blocks = plan.split("\n\n")
    windows = [b for b in blocks if b.lstrip().startswith("(") and ") Window" in b.splitlines()[0]]
    assert windows
    for b in windows:
        assert "customer_id" not in b


def test_no_cross_products_anywhere(spark):
    for name in ("customer_profile", "segments", "knn_filled_retention", "missing_cells_ltv",
                 "describe", "cohort_size"):
        plan = _plan(REGISTRY[name][0](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_hot_customer(spark, golden):
    """One customer owns a third of the rows: results equal a naive
    per-customer window formulation."""
    random.seed(3)
    rows = []
    for i in range(600):
        cust = "hot" if i % 3 == 0 else f"c{i % 40}"
        m = 1 + (i % 9)
        rows.append((f"t{i}", cust, f"2010-{m:02d}-0{1 + i % 8}", "2010-01-01", 10 + i % 7, M, F_, UK,
                     1 + i % 3, f"i{i % 13}"))
    txn = make_txn(spark, rows)
    purch = {(r.cohort, r.txn_month): (r.total_transactions, r.total_customers)
             for r in C.purchases(txn, P).collect()}
    w = Window.partitionBy("customer_id")
    naive = (txn.where("transaction_date is not null and customer_id is not null")
             .withColumn("cohort", F.trunc(F.min("transaction_date").over(w), "MM"))
             .withColumn("txn_month", F.trunc("transaction_date", "MM"))
             .groupBy("cohort", "txn_month")
             .agg(F.countDistinct("transaction_id").alias("t"), F.countDistinct("customer_id").alias("c")))
    assert purch == {(r.cohort, r.txn_month): (r.t, r.c) for r in naive.collect()}
    prof = CU.profile_rn(CU.profile_agg(txn, P), P)
    ref = prof.drop("RN").withColumn("RN", F.row_number().over(
        Window.partitionBy("cohort", "txn_month", "period_number")
        .orderBy("customer_id", "product_type", "transaction_item_code", "transaction_item_description")))
    assert prof.exceptAll(ref.select(*prof.columns)).count() == 0


def test_profile_rows_are_dealt_once(spark, golden):
    """Groups, distinct transactions and the cohort join share one exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(CU.profile_agg(golden, P))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [b for b in plan.split("\n\n") if ") Exchange" in b.partition("\n")[0] and "transaction_item_code" in b]
    assert len(moved) == 1, moved


def test_numbered_rows_stay_where_they_are(spark, golden):
    """The few offsets and cells are broadcast; no exchange after the slices."""
    prof = CU.profile_rn(CU.profile_agg(golden, P), P)
    for df in (prof, CU.attribute(prof, C.cohort_cells(golden, P), P)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
