"""Row-level cleaning and the two cohort assignments.

Branch A keeps complete, in-scope, non-return rows and takes the cohort from
the supplied ``first_transaction_month``. Branch B keeps every dated row and
derives the cohort from each customer's first transaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.functions import month_diff, month_start
from vintage.operators.ranking import _default_slices
from vintage.operators.skew import each_salt, frequent, salted, split_join
from vintage.params import Params

REQUIRED = ("transaction_id", "customer_id", "transaction_date", "first_transaction_month")


def drop_incomplete(txn: DataFrame) -> DataFrame:
    """drop rows with a null in any required key."""
    return txn.dropna(subset=list(REQUIRED))


def fill_amount(df: DataFrame) -> DataFrame:
    """a missing amount counts as 0."""
    return df.withColumn(
        "transaction_amount",
        F.coalesce(F.col("transaction_amount"), F.lit(0).cast("decimal(18,2)")))


def keep_scope(df: DataFrame, p: Params) -> DataFrame:
    """conjunction of equality filters (payment frequency, product type,
    country). Pushed into the Parquet scan as ``EqualTo`` predicates."""
    cond = F.lit(True)
    for col, value in p.filters.items():
        cond = cond & (F.col(col) == F.lit(value))
    return df.where(cond)


def exclude_returns(df: DataFrame) -> DataFrame:
    """returns have negative quantity; null quantity is dropped too."""
    return df.where(F.col("quantity") > 0)


def clean(txn: DataFrame, p: Params) -> DataFrame:
    """F1–F4 in the reference's order (Catalyst merges them into one filter)."""
    return exclude_returns(keep_scope(fill_amount(drop_incomplete(txn)), p))


def known_segments(df: DataFrame, p: Params) -> DataFrame:
    """Rows with a null segment key belong to no segment: group-by drops them
    (T5), so they leave before either branch groups."""
    return df.dropna(subset=list(p.segment_cols)) if p.segment_cols else df


def branch_a(txn: DataFrame, p: Params) -> DataFrame:
    """K1: cleaned rows with ``cohort`` (supplied first month) and
    ``txn_month``; only the columns the cell aggregates need survive, so the
    scan reads no more than that."""
    seg = list(p.segment_cols)
    return known_segments(clean(txn, p), p).select(
        *seg,
        month_start("first_transaction_month").alias("cohort"),
        month_start("transaction_date").alias("txn_month"),
        "customer_id", "transaction_amount",
    )


def first_transaction(txn: DataFrame) -> DataFrame:
    """A4: earliest transaction date per customer (null customers and null
    dates are ignored). A partial aggregate: each task sends one row per
    customer, so a customer with a third of all rows costs nothing extra."""
    return (txn.where(F.col("transaction_date").isNotNull() & F.col("customer_id").isNotNull())
            .groupBy("customer_id")
            .agg(F.min("transaction_date").alias("first_transaction_date")))


def dated(txn: DataFrame, p: Params) -> DataFrame:
    """Branch-B rows that can get a cohort (a date and a customer), minus the
    current month (F5, F6, half of F8), with their transaction month."""
    as_of = F.to_date(F.lit(p.as_of))
    return (txn.where(F.col("transaction_date").isNotNull() & F.col("customer_id").isNotNull())
            .withColumn("txn_month", month_start("transaction_date"))
            .where(F.col("txn_month") != as_of))


def with_cohort(rows: DataFrame, first: DataFrame, p: Params, split: bool = False) -> DataFrame:
    """K2 + F7/F8: attach the cohort (month of the customer's first
    transaction) and the period; keep cohorts in [min_cohort, as_of).

    The cohort bounds only touch ``first``'s columns, so Catalyst applies them
    to the per-customer table before the join. With AQE the join is broadcast
    when the customer table is small at run time and skew-split otherwise; no
    window partitioned by customer is used. ``split``: rows that weren't
    aggregated by customer before; heavy customers are spread by rule.
    """
    joined = split_join(rows, first, "customer_id") if split else rows.join(first, "customer_id", "inner")
    return cohort_bounds(joined, p)


def cohort_bounds(joined: DataFrame, p: Params) -> DataFrame:
    """Cohort and period of rows that have their customer's first date."""
    as_of = F.to_date(F.lit(p.as_of))
    out = (joined
           .withColumn("cohort", month_start("first_transaction_date"))
           .withColumn("period_number", month_diff("txn_month", "cohort")))
    return out.where((F.col("cohort") >= F.to_date(F.lit(p.min_cohort))) & (F.col("cohort") < as_of))


def branch_b(txn: DataFrame, p: Params) -> DataFrame:
    """Every dated row, cohort = month of the customer's first
    transaction over *all* countries, products and returns (row level)."""
    return branch_b_rows(dated(txn, p), first_transaction(txn), p, split=True)


def branch_b_rows(rows: DataFrame, first: DataFrame, p: Params, split: bool) -> DataFrame:
    """Dated rows with their cohort, period and years (see :func:`branch_b`)."""
    return with_cohort(rows, first, p, split).select(
        "*",
        F.trunc("first_transaction_date", "YEAR").alias("first_transaction_yr"),
        F.trunc("transaction_date", "YEAR").alias("record_level_transaction_yr"),
    )


#: Bytes of input files whose groups a task of :func:`branch_b_grouped` holds.
GROUP_BYTES = 16 << 20


def branch_b_grouped(txn: DataFrame, p: Params, keys: list[str], aggs: list) -> DataFrame:
    """Branch B aggregated by (customer, month, ``keys``) *before* the cohort
    join. The cohort is a function of the customer, so grouping by customer
    and month equals grouping by cell and customer.

    The rows are dealt out once, by customer, and both the groups and the
    join find them there. Groups of heavy customers are spread over salts made
    of the group's own keys, so a group stays whole."""
    rows = known_segments(dated(txn, p), p)
    first, heavy = first_transaction(txn), frequent(rows, "customer_id", 0.01)
    dealt = salted(rows, "customer_id", heavy, ["txn_month", *keys])
    dealt = dealt.repartition(_default_slices(rows, GROUP_BYTES), "customer_id", "_salt")
    pre = dealt.groupBy("customer_id", "_salt", "txn_month", *keys).agg(*aggs)
    return cohort_bounds(pre.join(each_salt(first, "customer_id", heavy), ["customer_id", "_salt"]).drop("_salt"), p)
