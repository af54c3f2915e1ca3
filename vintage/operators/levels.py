"""The cell table at every level of several segment columns from one scan
(§2.11): every subset of the columns, the empty one included.

Counts and revenue add up, so branch A is aggregated once, to states per finest
segment and cell, and ``GROUPING SETS`` over the states give all levels. Distinct
transactions and customers don't add up: branch B is reduced once to the
transactions of each customer and month, each with the set of its finest
segments (as many as occur, not as many as lines). What a level counts once is
found inside that set, so nothing is repeated for the levels before the counts
of the cells. Rates, running sums, means
and LTV are computed after the roll-up, with the level as the segment. A level
without a column has ALL there; rows with a null in a column leave the levels
that keep it and stay in the others."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.functions import month_diff, month_start
from vintage.operators import cells as C
from vintage.operators.clean import clean, dated, first_transaction
from vintage.params import Params
from vintage.session import staged

#: What a level shows for a column it doesn't keep.
ALL = "(all)"


def levels(cols: list[str]) -> list[tuple[str, ...]]:
    """Every subset of ``cols``, finest first."""
    return [kept for n in range(len(cols), -1, -1) for kept in combinations(cols, n)]


def cell_states(txn: DataFrame, p: Params, cols: list[str]) -> DataFrame:
    """Branch A as mergeable states: rows with a customer and revenue by
    finest segment and cell."""
    return (clean(txn, p)
            .select(*cols, month_start("first_transaction_month").alias("cohort"), month_start("transaction_date").alias("txn_month"),
                    "customer_id", "transaction_amount")
            .groupBy(*cols, "cohort", "txn_month")
            .agg(F.count("customer_id").alias("no_of_customers"), F.sum("transaction_amount").alias("revenue_dec")))


def rolled_up(states: DataFrame, cols: list[str]) -> DataFrame:
    """The states summed at every level."""
    cell = ["cohort", "txn_month"]
    sets = [[*kept, *cell] for kept in levels(cols)]
    summed = (states.groupingSets(sets, *cols, *cell)
              .agg(F.sum("no_of_customers").alias("no_of_customers"), F.sum("revenue_dec").alias("revenue_dec"),
                   *[F.grouping(c).alias(f"_all_{c}") for c in cols]))
    for c in cols:
        summed = summed.where((F.col(f"_all_{c}") == 1) | F.col(c).isNotNull())
    return (summed.withColumns({c: F.when(F.col(f"_all_{c}") == 1, ALL).otherwise(F.col(c)) for c in cols})
            .drop(*[f"_all_{c}" for c in cols]).withColumn("period_number", month_diff("txn_month", "cohort")))


def at_levels(segments: Column, cols: list[str]) -> Column:
    """The distinct segments of all levels that the finest ones belong to; a
    segment with a null is none of the levels that keep the column."""
    def of(s: Column) -> Column:
        return F.array(*[F.struct(*[(s[c] if c in kept else F.lit(ALL)).alias(c) for c in cols]) for kept in levels(cols)])

    def known(s: Column) -> Column:
        return F.forall(F.array(*[s[c].isNotNull() for c in cols]), lambda x: x)
    return F.filter(F.array_distinct(F.flatten(F.transform(segments, of))), known)


def transaction_segments(txn: DataFrame, p: Params, cols: list[str]) -> DataFrame:
    """The set of (customer, month, transaction) of dated rows with its finest
    segments and earliest day, from one pass over the lines, written once."""
    return staged(dated(txn, p).groupBy("customer_id", "txn_month", "transaction_id")
                  .agg(F.sort_array(F.collect_set(F.struct(*cols))).alias("_segments"), F.min("transaction_date").alias("transaction_date")))


def purchases_at_levels(sets: DataFrame, p: Params, cols: list[str]) -> DataFrame:
    """K8 at every level (see ``cells.purchases_of``) of
    :func:`transaction_segments`. A customer's month is one row with the sets
    of segments that occur in it; it adds a customer to each of its levels'
    segments, and each of its transactions a pair. Transactions of several
    customers, few, are taken off."""
    keys, first = [*cols, "cohort", "txn_month", "period_number"], first_transaction(sets)
    months = (sets.groupBy("customer_id", "txn_month", "_segments").agg(F.count("transaction_id").alias("_n"))
              .groupBy("customer_id", "txn_month").agg(F.collect_list(F.struct("_n", "_segments")).alias("_own")))
    pairs = F.transform("_own", lambda o: F.transform(at_levels(o["_segments"], cols), lambda s: F.struct(s.alias("s"), o["_n"].alias("pairs"), F.lit(0).alias("customers"))))
    customers = F.transform(at_levels(F.flatten(F.col("_own._segments")), cols),
                            lambda s: F.struct(s.alias("s"), F.lit(0).cast("long").alias("pairs"), F.lit(1).alias("customers")))
    cell = (C.with_cohort(months, first, p).select("cohort", "txn_month", "period_number", F.explode(F.concat(F.flatten(pairs), customers)).alias("_c"))
            .select("cohort", "txn_month", "period_number", "_c.s.*", "_c.pairs", "_c.customers").groupBy(*keys)
            .agg(F.sum("pairs").alias("_pairs"), F.sum("customers").alias("total_customers")))
    shared = (C.with_cohort(C.of_several_customers(sets, []), first, p)
              .select("transaction_id", "cohort", "txn_month", "period_number", F.explode(at_levels(F.col("_segments"), cols)).alias("_s"))
              .select("transaction_id", "cohort", "txn_month", "period_number", "_s.*"))
    return C.purchase_counts(cell, shared, keys)


def cells_by_level(txn: DataFrame, p: Params, cols: tuple[str, ...] = ("country", "product_type")) -> DataFrame:
    """K13 for every level of ``cols``; ``p`` filters none of them."""
    if set(cols) & set(p.filters) or p.distinct_customers:
        raise ValueError("a level column is filtered, or distinct customers are asked for, which don't add up")
    own, q = list(cols), p.with_(segment_cols=tuple(cols))
    c = rolled_up(cell_states(txn, p, own), own)
    c = C.with_arpu(C.with_revenue(C.with_active_lost(C.with_retention(c, q), q), q))
    sets = transaction_segments(txn, p.with_(segment_cols=()), own)
    c = C.with_purchases(c, purchases_at_levels(sets, q, own), q)
    c = C.with_ltv(C.with_margin(C.with_ltv_inputs(c, q), q), q)
    return c.select(*own, *C.CELL_COLUMNS)
