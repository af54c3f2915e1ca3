"""Cohort x period matrices and report frames.

The canonical shape is the long cell table; wide pivots are produced only as
the final step (``groupBy(cohort).pivot(period)``), after nulls are dropped
so that an all-missing cohort or period disappears as in a pandas
``pivot_table`` (T6). All inputs here are cell tables (months² / 2 rows per
segment), so these plans are small whatever the size of the transaction data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.functions import fixed, general, stable_avg
from vintage.params import Params

# measure name -> (cell column, decimals it carries)
MEASURES = {
    "retention": ("retention_rate_pc", 2),
    "churn": ("churn_rate_pc", 2),
    "ltv": ("traditional_ltv", 1),
    "active": ("active_cust", 0),
    "lost": ("lost_cust", 0),
}


def cohort_label(c="cohort"):
    return F.date_format(F.col(c), "yyyy-MM")


def abs_rates(cells: DataFrame) -> DataFrame:
    """Retention and churn as fractions."""
    return (cells.withColumn("retention_rate_abs_val", F.col("retention_rate_pc") / F.lit(100.0))
            .withColumn("churn_rate_abs_val", F.col("churn_rate_pc") / F.lit(100.0)))


def observed(cells: DataFrame, value: str, p: Params) -> DataFrame:
    """Non-null cells of one measure, long form with the cohort label."""
    return (cells.where(F.col(value).isNotNull())
            .select(*p.segment_cols, cohort_label().alias("cohort"), "period_number",
                    F.col(value).alias("value")))


def pivot(cells: DataFrame, value: str, p: Params, periods: list[int] | None = None) -> DataFrame:
    """M1: cohort rows x period columns (mean per cell = the value). With
    ``periods`` the columns are those, in that order, and no job looks for
    them; without, they are the periods that have a value."""
    return (observed(cells, value, p).groupBy(*p.segment_cols, "cohort")
            .pivot("period_number", periods).agg(F.avg("value")))


def pivot_t(cells: DataFrame, value: str, p: Params, cohorts: list[str] | None = None) -> DataFrame:
    """M2: period rows x cohort columns (``cohorts``: labels YYYY-MM, as
    ``periods`` of :func:`pivot`)."""
    return (observed(cells, value, p).groupBy(*p.segment_cols, "period_number")
            .pivot("cohort", cohorts).agg(F.avg("value")))


def cohort_size(cells: DataFrame, value: str, p: Params) -> DataFrame:
    """M3: the first column of the pivot of ``value`` — the value at the
    smallest period present (per segment) for every cohort row of that pivot,
    NULL when the cohort has no cell there."""
    obs = observed(cells, value, p)
    seg = list(p.segment_cols)
    rows = obs.select(*seg, "cohort").distinct()
    if seg:
        first = obs.groupBy(*seg).agg(F.min("period_number").alias("_p0"))
        at = (obs.join(first, seg).where(F.col("period_number") == F.col("_p0"))
              .select(*seg, "cohort", F.col("value").alias("cohort_size")))
    else:
        p0 = obs.agg(F.min("period_number")).scalar()
        at = obs.where(F.col("period_number") == p0).select("cohort", F.col("value").alias("cohort_size"))
    return rows.join(at, [*seg, "cohort"], "left")


def curve(cells: DataFrame, value: str, places: int, p: Params,
          max_period: int | None = None, fmt: str | None = None) -> DataFrame:
    """Mean of a measure per period number over cohorts (order
    independent, see ``stable_avg``), optionally only up to ``max_period``,
    with a text label: ``fmt`` holds the place of the mean with one decimal."""
    c = cells if max_period is None else cells.where(F.col("period_number") <= max_period)
    out = c.groupBy(*p.segment_cols, "period_number").agg(stable_avg(value, places).alias(value))
    if fmt is not None:
        y = F.col(value)
        out = out.withColumn("label", F.when(y.isNotNull(), F.format_string(fmt, fixed(y, 1))))
    return out


def heatmap_frame(cells: DataFrame, measure: str, p: Params) -> DataFrame:
    """Long-form heatmap: cohort, period, value, annotation and the
    cohort-size side column. Rates are shown as fractions labelled ``0%``
    (rounded half to even, as Python's ``%`` format does); LTV and counts as
    float text (``123.0``, ``inf``). The side column is the customer count at
    the first period, except for LTV where it is the first LTV column; its
    label has the ``g`` format."""
    col, _ = MEASURES[measure]
    seg = list(p.segment_cols)
    if measure in ("retention", "churn"):
        cells = abs_rates(cells)
        col = col.replace("_pc", "_abs_val")
        lab = F.format_string("%.0f%%", F.rint(F.col("value") * F.lit(100.0)))
    else:
        lab = fixed("value", 1)  # LTVs carry one decimal, counts none
    obs = observed(cells, col, p).withColumn("label", lab)
    size_col = "traditional_ltv" if measure == "ltv" else "no_of_customers"
    size = cohort_size(cells, size_col, p)
    return obs.join(size, [*seg, "cohort"], "left").withColumn("size_label", general("cohort_size"))
