"""Customer layer: the customer x product profile
with once-per-cell attribution, the customers behind each cohort cell, and
LTV segments.

Scale notes. The profile is the largest table in the analysis (one row per
cell, customer and product) and its cells are few and large, so nothing here
partitions by cell alone:
* ``RN`` (the position of a profile row inside its cell) uses the
  range-sliced running count of ``ranking``.
* ``cohort_customers`` only needs to know which row of a cell is first, so it
  never computes ``RN``: the first key per cell is a partial aggregate
  (``min`` of a struct), and each (cell, customer) pair is another.
* Cell-level tables are tiny (months² / 2 rows); AQE broadcasts them at run
  time when they are under the broadcast threshold and falls back to a
  shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.operators.cells import CELL_COLUMNS
from vintage.operators.clean import branch_b_grouped
from vintage.operators.quantiles import exact_quantiles
from vintage.operators.ranking import row_number_within
from vintage.params import Params
from vintage.session import materialize, staged

ITEM_KEYS = ("customer_id", "product_type", "transaction_item_code", "transaction_item_description")

# Cell columns zeroed on every profile row except the first of its cell.
ZEROED_DOUBLE = ("no_of_cust_purchases", "retention_rate_pc", "retention_rate_for_cltv",
                 "retention_rate_cohort_avg", "churn_rate_pc", "revenue", "cumulative_revenue",
                 "avg_revenue_per_user", "avg_profit_margin_per_cohort", "traditional_ltv")
ZEROED_LONG = ("active_cust", "lost_cust")


def _cell(p: Params) -> list[str]:
    return [*p.segment_cols, "cohort", "txn_month", "period_number"]


def profile_agg(txn: DataFrame, p: Params) -> DataFrame:
    """Per (cell, customer, product type, item code, description):
    distinct transactions, total quantity, total amount. Rows with a null
    key are dropped (as a pandas group-by does); empty sums are 0. Aggregated
    per (customer, month, item) before the cohort join (see
    ``branch_b_grouped``)."""
    item = ["product_type", "transaction_item_code", "transaction_item_description"]
    rows = txn.dropna(subset=list(ITEM_KEYS))  # null segments go in branch B
    pre = branch_b_grouped(rows, p, [*p.segment_cols, *item], [
        F.countDistinct("transaction_id").alias("transaction_id"),
        F.coalesce(F.sum("quantity"), F.lit(0).cast("bigint")).alias("quantity"),
        F.coalesce(F.sum("transaction_amount"), F.lit(0).cast("decimal(28,2)"))
        .cast("double").alias("transaction_amount")])
    return pre.select(*_cell(p), *ITEM_KEYS, "transaction_id", "quantity", "transaction_amount")


def profile_rn(profile: DataFrame, p: Params) -> DataFrame:
    """RN = 1-based position within the cell, ordered by customer,
    product type, item code, description (unique within a cell)."""
    return row_number_within(profile, _cell(p), list(ITEM_KEYS), out="RN")


def attribute(profile_with_rn: DataFrame, cells: DataFrame, p: Params) -> DataFrame:
    """J8 + T9: join the cell metrics onto every profile row and keep them
    only on the first row of each cell. The cells are written first: as few as
    they are, they are broadcast then, and the profile stays where it is."""
    cell_cols = [c for c in CELL_COLUMNS if c not in ("cohort", "txn_month", "period_number")]
    j = profile_with_rn.join(staged(cells.select(*_cell(p), *cell_cols)), _cell(p), "left")
    first = F.col("RN") == 1
    out = j.withColumn("total_acquired_customers",
                       F.when(first, F.coalesce(F.col("total_customers"), F.lit(0).cast("bigint")))
                       .otherwise(F.lit(0).cast("bigint")))
    out = out.withColumn("total_customers",
                         F.coalesce(F.when(first, F.col("no_of_customers")).otherwise(F.col("total_customers")),
                                    F.lit(0).cast("bigint")))
    out = out.withColumn("total_transactions",
                         F.coalesce(F.col("total_transactions"), F.lit(0).cast("bigint")))
    for c in ZEROED_DOUBLE:
        out = out.withColumn(c, F.when(first, F.col(c)).otherwise(F.lit(0.0)))
    for c in ZEROED_LONG:
        out = out.withColumn(c, F.when(first, F.col(c)).otherwise(F.lit(0).cast("bigint")))
    return out


def customer_profile(txn: DataFrame, cells: DataFrame, p: Params) -> DataFrame:
    """Aggregated profile, RN, attributed cell metrics."""
    return attribute(profile_rn(profile_agg(txn, p), p), cells, p)


def cohort_customers(txn: DataFrame, cells: DataFrame, p: Params) -> DataFrame:
    """Customers behind each cell with ``cltv_interim`` = the minimum
    attributed LTV over the customer's profile rows in the cell, joined to
    the cell metrics, kept where the cell has an LTV.

    Only the cell's first profile row keeps the LTV (0 elsewhere), and the
    first row belongs to the smallest customer id of the cell. So the minimum
    is: for that customer, the cell LTV when it has one profile row in the
    cell, else min(LTV, 0) (0 when the LTV is missing); 0 for every other
    customer. Computed from the per-(cell, customer) row counts and their
    per-cell minimum customer — partial aggregates, no per-cell sort.
    """
    cell = _cell(p)
    per_cust = (profile_agg(txn, p).groupBy(*cell, "customer_id")
                .agg(F.count(F.lit(1)).alias("_rows")))
    first = per_cust.groupBy(*cell).agg(F.min("customer_id").alias("_first_customer"))
    cc = per_cust.join(first, cell, "inner").join(cells, cell, "left")
    ltv = F.col("traditional_ltv")
    interim = (F.when(F.col("customer_id") != F.col("_first_customer"), F.lit(0.0))
               .when(F.col("_rows") == 1, ltv)
               .otherwise(F.least(F.coalesce(ltv, F.lit(0.0)), F.lit(0.0))))
    cc = cc.withColumn("cltv_interim", interim)
    cc = cc.withColumn("ltv_flag", F.when(ltv.isNotNull(), F.lit(1)).otherwise(F.lit(0)))
    cell_cols = [c for c in CELL_COLUMNS if c not in ("cohort", "txn_month", "period_number")]
    return (cc.where(F.col("ltv_flag") == 1)
            .select(*cell, "customer_id", "cltv_interim", *cell_cols, "ltv_flag"))


def customer_ltv(cohort_cust: DataFrame, p: Params) -> DataFrame:
    """Independent maxima of cohort, period and cell LTV per customer."""
    return (cohort_cust.groupBy(*p.segment_cols, "customer_id")
            .agg(F.max("cohort").alias("cohort"), F.max("period_number").alias("period_number"),
                 F.max("traditional_ltv").alias("traditional_ltv")))


def _threshold_frames(cells: DataFrame, cust_ltv: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Both histograms are bounded by the number of cells: customer LTVs are cell LTVs.
    qc = exact_quantiles(cells, "traditional_ltv", [0.5, 0.8], ["cells_q50", "cells_q80"],
                         bounded_values=True)
    qk = exact_quantiles(cust_ltv, "traditional_ltv", [0.5, 0.8], ["customers_q50", "customers_q80"],
                         bounded_values=True)
    return qc, qk


def ltv_thresholds(cells: DataFrame, cust_ltv: DataFrame) -> DataFrame:
    """A10 + A11: median and 80th percentile of the cell LTVs and of the
    customer LTVs (one row). The customer LTV takes at most as many distinct
    values as there are cells, so its histogram stays small."""
    qc, qk = _threshold_frames(cells, cust_ltv)
    return qc.select("cells_q50", "cells_q80",
                     qk.select("customers_q50").scalar().alias("customers_q50"),
                     qk.select("customers_q80").scalar().alias("customers_q80"))


def segments(cells: DataFrame, cohort_cust: DataFrame, p: Params) -> DataFrame:
    """Low / medium / high / unknown LTV segment per customer, with the
    reference's precedence (low, then medium, then high). Thresholds enter
    the projection as scalar subqueries (computed once, no join). The
    customer table feeds both the output and its own quantiles, so it is
    written once instead of re-deriving the profile chain twice."""
    cust = materialize(customer_ltv(cohort_cust, p))
    if p.segment_cols:
        return _segments_by_segment(cells, cust, p)
    qc, qk = _threshold_frames(cells, cust)
    # one scalar subquery per quantile frame, fields read from its struct
    sc = qc.select(F.struct(*qc.columns)).scalar()
    sk = qk.select(F.struct(*qk.columns)).scalar()
    q = {k: sc.getField(k) for k in qc.columns}
    q.update({k: sk.getField(k) for k in qk.columns})
    ltv = F.col("traditional_ltv")
    seg = (F.when(ltv < q["cells_q50"], F.lit("low_cltv"))
           .when((q["customers_q50"] <= ltv) & (ltv < q["customers_q80"]), F.lit("medium_cltv"))
           .when(ltv >= q["cells_q80"], F.lit("high_cltv"))
           .otherwise(F.lit("unknown")))
    return cust.withColumn("traditional_ltv_segments", seg)


def _segments_by_segment(cells: DataFrame, cust: DataFrame, p: Params) -> DataFrame:
    """K16 with ``segment_cols``: every segment gets its own four thresholds
    (grouped exact quantiles, one row per segment) joined on the segment."""
    seg = tuple(p.segment_cols)
    qc = exact_quantiles(cells, "traditional_ltv", [0.5, 0.8], ["cells_q50", "cells_q80"],
                         group_cols=seg, bounded_values=True)
    qk = exact_quantiles(cust, "traditional_ltv", [0.5, 0.8], ["customers_q50", "customers_q80"],
                         group_cols=seg, bounded_values=True)
    j = cust.join(qc, list(seg), "left").join(qk, list(seg), "left")
    ltv = F.col("traditional_ltv")
    seg_label = (F.when(ltv < F.col("cells_q50"), F.lit("low_cltv"))
                 .when((F.col("customers_q50") <= ltv) & (ltv < F.col("customers_q80")), F.lit("medium_cltv"))
                 .when(ltv >= F.col("cells_q80"), F.lit("high_cltv"))
                 .otherwise(F.lit("unknown")))
    return j.select(*cust.columns, seg_label.alias("traditional_ltv_segments"))
