"""The cohort cell table: one row per (cohort,
transaction month), optionally per segment.

Physical shape: branch A is one partial/final hash aggregate that yields
count, revenue and period together (the reference builds three frames and
merges them back). All per-cohort quantities (cohort size, lost customers,
running revenue, next-period retention, cohort mean) are window functions over
that aggregate, partitioned by cohort. The aggregate has at most
months x months / 2 rows per segment, so those windows are tiny. Branch B's
purchase counts come from a second aggregate and are joined by cell key; AQE
sees the run-time size of both aggregates and broadcasts one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions import ltv_quotient, month_diff, nan_to_null, rnd, stable_avg
from vintage.operators.clean import branch_a, dated, first_transaction, known_segments, with_cohort
from vintage.params import Params
from vintage.session import staged

CELL_KEYS = ("cohort", "txn_month")


def _keys(p: Params) -> list[str]:
    return [*p.segment_cols, *CELL_KEYS]


def _by_cohort(p: Params) -> Window:
    return Window.partitionBy(*p.segment_cols, "cohort")


def _by_cohort_ordered(p: Params) -> Window:
    return _by_cohort(p).orderBy("txn_month")


def cohort_counts(rows_a: DataFrame, p: Params) -> DataFrame:
    """A1 + A2: customers (row count, as the reference does; distinct on
    request) and revenue per cell, plus the period number."""
    n = (F.countDistinct("customer_id") if p.distinct_customers else F.count("customer_id"))
    return (rows_a.groupBy(*_keys(p))
            .agg(n.alias("no_of_customers"),
                 F.sum("transaction_amount").alias("revenue_dec"))
            .withColumn("period_number", month_diff("txn_month", "cohort")))


def with_retention(cells: DataFrame, p: Params) -> DataFrame:
    """K3 + K4: retention % against the period-0 cell of the cohort (NULL
    when there is none); churn = 100 - retention with 0 rewritten to 100."""
    n0 = F.max(F.when(F.col("period_number") == 0, F.col("no_of_customers"))).over(_by_cohort(p))
    ret = rnd((F.lit(100) * F.col("no_of_customers")) / n0, 2)
    churn = rnd(F.lit(100.0) - F.col("retention_rate_pc"), 2)
    return (cells.withColumn("retention_rate_pc", ret)
            .withColumn("churn_rate_pc", F.when(churn == 0.0, F.lit(100.0)).otherwise(churn)))


def with_active_lost(cells: DataFrame, p: Params) -> DataFrame:
    """K5: active = customers; lost = |active - previous observed active|,
    the cohort's first cell counts all its customers as lost."""
    prev = F.lag("no_of_customers").over(_by_cohort_ordered(p))
    return (cells.withColumn("active_cust", F.col("no_of_customers"))
            .withColumn("lost_cust", F.coalesce(F.abs(F.col("no_of_customers") - prev),
                                                F.col("no_of_customers"))))


def with_revenue(cells: DataFrame, p: Params) -> DataFrame:
    """K6: revenue and running revenue within the cohort. Sums stay decimal
    (exact, order independent) and become double at the end."""
    w = _by_cohort_ordered(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (cells.withColumn("revenue", F.col("revenue_dec").cast("double"))
            .withColumn("cumulative_revenue", F.sum("revenue_dec").over(w).cast("double")))


def with_arpu(cells: DataFrame) -> DataFrame:
    """K7: average revenue per user = running revenue / customers."""
    return cells.withColumn(
        "avg_revenue_per_user", rnd(F.col("cumulative_revenue") / F.col("no_of_customers"), 2))


def base_cells(txn: DataFrame, p: Params) -> DataFrame:
    """Branch A cells with K3–K7."""
    c = cohort_counts(branch_a(txn, p), p)
    c = with_retention(c, p)
    c = with_active_lost(c, p)
    c = with_revenue(c, p)
    return with_arpu(c)


def transaction_set(txn: DataFrame, p: Params, cols: list[str]) -> DataFrame:
    """The set of (``cols``, customer, month, transaction) of dated rows with
    its earliest day, from one pass over the lines. It is counted several ways,
    so it is written once; it has a row per transaction, not per line."""
    return staged(dated(txn, p).groupBy(*cols, "customer_id", "txn_month", "transaction_id")
                  .agg(F.min("transaction_date").alias("transaction_date")))


def purchases(txn: DataFrame, p: Params) -> DataFrame:
    """K8 on branch B: distinct transactions and customers per cell and their
    ratio (see :func:`purchases_of`)."""
    pairs = transaction_set(txn, p, list(p.segment_cols))
    return purchases_of(known_segments(pairs, p), first_transaction(pairs), p)


def purchases_of(pairs: DataFrame, first: DataFrame, p: Params) -> DataFrame:
    """K8 of a set of (segment, customer, month, transaction); ``first``: the
    customers' first dates.

    A customer is in one cell a month, so per customer and month the set is
    counted before the cohort join, and a cell's customers and (customer,
    transaction) pairs are plain sums; nothing is expanded for two distinct
    counts. A transaction of several customers makes more than one pair of a
    cell; those few, found by one more count of the set, are taken off."""
    seg = list(p.segment_cols)
    keys = [*seg, "cohort", "txn_month", "period_number"]
    per_customer = pairs.groupBy(*seg, "customer_id", "txn_month").agg(F.count("transaction_id").alias("_pairs"))
    cell = (with_cohort(per_customer, first, p).groupBy(*keys)
            .agg(F.sum("_pairs").alias("_pairs"), F.count(F.lit(1)).alias("total_customers")))
    return purchase_counts(cell, with_cohort(of_several_customers(pairs, seg), first, p), keys)


def of_several_customers(pairs: DataFrame, seg: list[str]) -> DataFrame:
    """The elements of a transaction set whose transaction has several
    customers in a segment and month. They are few as a rule; their list is
    written, so that the planner knows whether the set must move for it."""
    several = (pairs.groupBy(*seg, "txn_month", "transaction_id").agg(F.count(F.lit(1)).alias("_customers"))
               .where("_customers > 1 and transaction_id is not null").drop("_customers"))
    return pairs.join(staged(several), [*seg, "txn_month", "transaction_id"], "left_semi")


def purchase_counts(cell: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """Transactions, customers and their ratio by cell: ``cell`` has the pairs
    of customer and transaction, ``shared`` those of :func:`of_several_customers`."""
    over = shared.groupBy(*keys).agg((F.count(F.lit(1)) - F.countDistinct("transaction_id")).alias("_over"))
    total = F.col("_pairs") - F.coalesce(F.col("_over"), F.lit(0))
    return (cell.join(over, keys, "left")
            .select(*keys, total.alias("total_transactions"), "total_customers")
            .withColumn("no_of_cust_purchases",
                        rnd(F.col("total_transactions") / F.col("total_customers"), 1)))


def with_purchases(cells: DataFrame, purch: DataFrame, p: Params) -> DataFrame:
    """Left join of branch-B purchase counts on the cell key."""
    return cells.join(purch, [*p.segment_cols, "cohort", "txn_month", "period_number"], "left")


def with_ltv_inputs(cells: DataFrame, p: Params) -> DataFrame:
    """K9 + K10: next observed retention in the cohort, its cohort mean
    (rounded to 1 place) and the fallback of the last cell to that mean."""
    nxt = F.lead("retention_rate_pc").over(_by_cohort_ordered(p))
    c = (cells.withColumn("period_number_for_cltv", F.col("period_number") + 1)
         .withColumn("_next_ret", nxt))
    c = c.withColumn("retention_rate_cohort_avg",
                     rnd(stable_avg("_next_ret", 2, over=_by_cohort(p)), 1))
    return (c.withColumn("retention_rate_for_cltv",
                         F.coalesce(F.col("_next_ret"), F.col("retention_rate_cohort_avg")))
            .drop("_next_ret"))


def with_margin(cells: DataFrame, p: Params) -> DataFrame:
    """``(arpu * margin_rate) * ((period + 1) * purchases)``."""
    return cells.withColumn(
        "avg_profit_margin_per_cohort",
        (F.col("avg_revenue_per_user") * F.lit(float(p.margin_rate)))
        * (F.col("period_number_for_cltv") * F.col("no_of_cust_purchases")))


def with_ltv(cells: DataFrame, p: Params) -> DataFrame:
    """``margin * ((r/100) / ((1 + d) - r/100))`` rounded to 1 place;
    ±infinity where the denominator vanishes, missing for 0 x infinity."""
    raw = F.col("avg_profit_margin_per_cohort") * ltv_quotient("retention_rate_for_cltv",
                                                               p.discount_rate)
    return cells.withColumn("traditional_ltv", rnd(nan_to_null(raw), 1))


CELL_COLUMNS = [
    "cohort", "txn_month", "period_number", "no_of_customers", "retention_rate_pc",
    "churn_rate_pc", "active_cust", "lost_cust", "revenue", "cumulative_revenue",
    "avg_revenue_per_user", "total_transactions", "total_customers", "no_of_cust_purchases",
    "period_number_for_cltv", "retention_rate_for_cltv", "retention_rate_cohort_avg",
    "avg_profit_margin_per_cohort", "traditional_ltv",
]


def cohort_cells(txn: DataFrame, p: Params) -> DataFrame:
    """K13 (flagship): the full cell table, K3–K12."""
    c = with_purchases(base_cells(txn, p), purchases(txn, p), p)
    c = with_ltv_inputs(c, p)
    c = with_margin(c, p)
    c = with_ltv(c, p)
    return c.select(*p.segment_cols, *CELL_COLUMNS)
