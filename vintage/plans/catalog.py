"""The query catalogue: every operator of SURVEY §2 as a named query over the
driver tables, each with its DuckDB oracle SQL (or ``None`` for rows-only
checks). ``__spark_entry__`` only re-exports this registry.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.operators import cells as C
from vintage.operators import clean as K
from vintage.operators import incremental as INC
from vintage.operators import levels as LV
from vintage.operators import sketches as SK
from vintage.params import FIXTURE_FIRST_MONTH, months_between
from vintage.params import FIXTURE_PARAMS as P
from vintage.plans import oracle as O
from vintage.plans.sqlfrag import with_ctes
from vintage.session import ensure_checkpoint_dir, materialize, staged
from vintage.sources import transactions, transactions_from_tables
from vintage.sources.store import buckets_for, write_customer_store

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, Callable[[], str] | None]] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def txn(spark: SparkSession, sf_dir: str, merge_parts: bool = False) -> DataFrame:
    """The transaction table (see ``sources.transactions``)."""
    return transactions(spark, sf_dir, merge_parts)


def _sql(ctes, final):
    return lambda: with_ctes(ctes(), final)


# ---------------------------------------------------------------- sources / cleaning
@register("transactions", _sql(O.transactions_ctes, "SELECT * FROM transactions"))
def q_transactions(spark, sf):
    """The typed transaction table, mapped from the driver tables."""
    return transactions_from_tables(spark, sf)


@register("clean_required", _sql(O.transactions_ctes,
          "SELECT * FROM transactions WHERE transaction_id IS NOT NULL AND customer_id IS NOT NULL "
          "AND transaction_date IS NOT NULL AND first_transaction_month IS NOT NULL"))
def q_clean_required(spark, sf):
    """F1."""
    return K.drop_incomplete(txn(spark, sf))


@register("clean_filters", _sql(O.transactions_ctes,
          "SELECT * REPLACE (COALESCE(transaction_amount, CAST(0 AS DECIMAL(18,2))) AS transaction_amount) "
          f"FROM transactions WHERE {O.clean_where(P)}"))
def q_clean_filters(spark, sf):
    """F1–F4."""
    return K.clean(txn(spark, sf), P)


_BRANCH_B_COLS = ("customer_id, transaction_id, transaction_date, first_transaction_date, "
                  "first_transaction_yr, record_level_transaction_yr, cohort, txn_month, period_number, "
                  "transaction_amount, quantity, product_type, transaction_item_code")


@register("branch_b", lambda: with_ctes([*O.transactions_ctes(), *O.branch_b_ctes(P)],
                                         f"SELECT {_BRANCH_B_COLS} FROM rows_b"))
def q_branch_b(spark, sf):
    """F5–F8, K2, X5."""
    return K.branch_b(txn(spark, sf), P).select(*[c.strip() for c in _BRANCH_B_COLS.split(",")])


def _store(spark, sf):
    """The mapped table by customer, in a new folder below the shared one."""
    name = f"transactions_{uuid.uuid4().hex[:12]}"
    t = txn(spark, sf)
    return write_customer_store(t, name, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}", buckets=buckets_for(t))


@register("branch_b_stored", lambda: with_ctes([*O.transactions_ctes(), *O.branch_b_ctes(P)],
                                                f"SELECT {_BRANCH_B_COLS} FROM rows_b"))
def q_branch_b_stored(spark, sf):
    """F5–F8, K2, X5 over a table bucketed by customer."""
    return _store(spark, sf).branch_b(P).select(*[c.strip() for c in _BRANCH_B_COLS.split(",")])


@register("first_transaction_stored", lambda: with_ctes([*O.transactions_ctes(), *O.branch_b_ctes(P)],
                                                         "SELECT * FROM first_txn"))
def q_first_transaction_stored(spark, sf):
    """A4 over a table bucketed by customer."""
    return _store(spark, sf).first_transactions()


@register("first_transaction", lambda: with_ctes([*O.transactions_ctes(), *O.branch_b_ctes(P)],
                                                  "SELECT * FROM first_txn"))
def q_first_transaction(spark, sf):
    """A4."""
    return K.first_transaction(txn(spark, sf))


# ---------------------------------------------------------------- cells
def _base(spark, sf):
    return C.base_cells(txn(spark, sf), P)


def _cells_sql(final):
    return lambda: with_ctes([*O.transactions_ctes(), *O.cells_ctes(P)], final)


_K = "cohort, txn_month, period_number"


@register("cohort_counts", _cells_sql(f"SELECT {_K}, no_of_customers FROM counts"))
def q_cohort_counts(spark, sf):
    """A1."""
    return C.cohort_counts(K.branch_a(txn(spark, sf), P), P).select(*_K.split(", "), "no_of_customers")


@register("retention", _cells_sql(f"SELECT {_K}, no_of_customers, retention_rate_pc FROM ret"))
def q_retention(spark, sf):
    """K3."""
    return _base(spark, sf).select(*_K.split(", "), "no_of_customers", "retention_rate_pc")


@register("churn", _cells_sql(f"SELECT {_K}, retention_rate_pc, churn_rate_pc FROM step2"))
def q_churn(spark, sf):
    """K4."""
    return _base(spark, sf).select(*_K.split(", "), "retention_rate_pc", "churn_rate_pc")


@register("active_lost", _cells_sql(f"SELECT {_K}, active_cust, lost_cust FROM step2"))
def q_active_lost(spark, sf):
    """K5 (W1)."""
    return _base(spark, sf).select(*_K.split(", "), "active_cust", "lost_cust")


@register("revenue", _cells_sql(f"SELECT {_K}, revenue FROM step2"))
def q_revenue(spark, sf):
    """A2."""
    return _base(spark, sf).select(*_K.split(", "), "revenue")


@register("cumulative_revenue", _cells_sql(f"SELECT {_K}, revenue, cumulative_revenue FROM step2"))
def q_cumulative_revenue(spark, sf):
    """K6 (W2)."""
    return _base(spark, sf).select(*_K.split(", "), "revenue", "cumulative_revenue")


@register("arpu", _cells_sql(f"SELECT {_K}, no_of_customers, cumulative_revenue, avg_revenue_per_user FROM base"))
def q_arpu(spark, sf):
    """K7."""
    return _base(spark, sf).select(*_K.split(", "), "no_of_customers", "cumulative_revenue",
                                   "avg_revenue_per_user")


@register("purchases", lambda: with_ctes(
    [*O.transactions_ctes(), *O.branch_b_ctes(P), *O.purchases_ctes(P)], "SELECT * FROM purch"))
def q_purchases(spark, sf):
    """K8 (A5)."""
    return C.purchases(txn(spark, sf), P)


def _full_sql(final):
    return lambda: with_ctes(O.full_cells_ctes(P), final)


@register("ltv_inputs", _full_sql(
    f"SELECT {_K}, period_number_for_cltv, retention_rate_for_cltv, retention_rate_cohort_avg FROM cells"))
def q_ltv_inputs(spark, sf):
    """K9, K10 (W3, A6)."""
    return q_cohort_cells(spark, sf).select(*_K.split(", "), "period_number_for_cltv",
                                            "retention_rate_for_cltv", "retention_rate_cohort_avg")


@register("margin", _full_sql(
    f"SELECT {_K}, avg_revenue_per_user, no_of_cust_purchases, avg_profit_margin_per_cohort FROM cells"))
def q_margin(spark, sf):
    """K11."""
    return q_cohort_cells(spark, sf).select(*_K.split(", "), "avg_revenue_per_user",
                                            "no_of_cust_purchases", "avg_profit_margin_per_cohort")


@register("traditional_ltv", _full_sql(f"SELECT {_K}, retention_rate_for_cltv, traditional_ltv FROM cells"))
def q_traditional_ltv(spark, sf):
    """K12."""
    return q_cohort_cells(spark, sf).select(*_K.split(", "), "retention_rate_for_cltv", "traditional_ltv")


@register("cohort_cells", _full_sql("SELECT * FROM cells"))
def q_cohort_cells(spark, sf):
    """K13 — flagship."""
    return C.cohort_cells(txn(spark, sf), P)


# ---------------------------------------------------------------- profile
from vintage.operators import profile as PR  # noqa: E402


def _info_sql(final):
    return lambda: with_ctes(O.profile_info_ctes(), final)


@register("head5", lambda: O.head_sql(5))
def q_head5(spark, sf):
    """P1."""
    return PR.head(txn(spark, sf), 5)


@register("columns", _info_sql('SELECT position, "column", non_null FROM info'))
def q_columns(spark, sf):
    """P2."""
    return PR.columns(txn(spark, sf))


@register("describe", O.describe_sql)
def q_describe(spark, sf):
    """P3."""
    return PR.describe(txn(spark, sf))


@register("dtypes", _info_sql('SELECT "column", type, non_null FROM info'))
def q_dtypes(spark, sf):
    """P4."""
    return PR.dtypes(txn(spark, sf))


@register("columns_by_type", _info_sql(
    "SELECT type, string_agg(\"column\", ', ' ORDER BY \"column\") AS columns, CAST(sum(non_null) AS BIGINT) AS non_null FROM info GROUP BY type"))
def q_columns_by_type(spark, sf):
    """P5."""
    return PR.columns_by_type(txn(spark, sf))


@register("non_null_info", _info_sql('SELECT position, "column", non_null, type FROM info'))
def q_non_null_info(spark, sf):
    """P6."""
    return PR.non_null_info(txn(spark, sf))


@register("any_null", _info_sql('SELECT "column", (_rows - non_null) > 0 AS has_null FROM info'))
def q_any_null(spark, sf):
    """P7."""
    return PR.any_null(txn(spark, sf))


@register("null_counts", _info_sql('SELECT "column", _rows - non_null AS n_null FROM info'))
def q_null_counts(spark, sf):
    """P8."""
    return PR.null_counts(txn(spark, sf))


@register("n_unique_approx", O.n_unique_sql)
def q_n_unique_approx(spark, sf):
    """P9, approximate option (sketches; exact for so few values)."""
    return PR.n_unique_approx(txn(spark, sf))


@register("approx_customers", O.approx_customers_sql)
def q_approx_customers(spark, sf):
    """P9's sketches kept by month and country and merged to three levels
    (month, country, all): the exact count and whether the merged estimate
    lies within 4 standard errors of it."""
    t = txn(spark, sf).where("transaction_date is not null").select(
        F.date_format("transaction_date", "yyyy-MM").alias("month"), "country", "customer_id")
    cells = materialize(SK.cell_sketches(t, ["month", "country"], ("customer_id",)))
    out = []
    for level, keys in (("month", ["month"]), ("country", ["country"]), ("all", [])):
        key = F.col(keys[0]) if keys else F.lit("all")
        found = SK.estimates(SK.merged(cells, keys, ("customer_id",)), ("customer_id",))
        exact = t.groupBy(*keys).agg(F.countDistinct("customer_id").alias("n_customers"))
        found = found.select(key.alias("key"), F.col("customer_id").alias("_est"))
        exact = exact.select(key.alias("key"), "n_customers")
        near = F.abs(F.col("_est") - F.col("n_customers")) <= F.lit(4 * SK.error()) * F.col("n_customers")
        out.append(exact.join(found, "key").select(F.lit(level).alias("level"), "key", "n_customers", near.alias("within_bound")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("n_unique", O.n_unique_sql)
def q_n_unique(spark, sf):
    """P9."""
    return PR.n_unique(txn(spark, sf))


@register("unique_values", O.unique_values_sql)
def q_unique_values(spark, sf):
    """P10."""
    return PR.unique_values(txn(spark, sf))


# ---------------------------------------------------------------- customers
from vintage.operators import customers as CU  # noqa: E402


def _cust_sql(final):
    return lambda: with_ctes(O.customers_ctes(P), final)




@register("profile_agg", _cust_sql("SELECT * FROM prof"))
def q_profile_agg(spark, sf):
    """A7."""
    return CU.profile_agg(txn(spark, sf), P)


@register("profile_rn", _cust_sql("SELECT * FROM prof_rn"))
def q_profile_rn(spark, sf):
    """W4."""
    return CU.profile_rn(CU.profile_agg(txn(spark, sf), P), P)


@register("customer_profile", _cust_sql("SELECT * FROM attributed"))
def q_customer_profile(spark, sf):
    """K14 (J8, T9)."""
    t = txn(spark, sf)
    return CU.customer_profile(t, C.cohort_cells(t, P), P)


def _cohort_customers(spark, sf):
    t = txn(spark, sf)
    cells = materialize(C.cohort_cells(t, P))
    return cells, CU.cohort_customers(t, cells, P)


@register("cohort_customers", _cust_sql("SELECT * FROM cohort_customers"))
def q_cohort_customers(spark, sf):
    """K15 (A8, J9, F9)."""
    return _cohort_customers(spark, sf)[1]


@register("customer_ltv", _cust_sql("SELECT * FROM customers_ltv"))
def q_customer_ltv(spark, sf):
    """A9."""
    return CU.customer_ltv(_cohort_customers(spark, sf)[1], P)


@register("ltv_quantiles", _cust_sql("SELECT * FROM thresholds"))
def q_ltv_quantiles(spark, sf):
    """A10, A11."""
    cells, cc = _cohort_customers(spark, sf)
    return CU.ltv_thresholds(cells, CU.customer_ltv(cc, P))


@register("segments", _cust_sql("SELECT * FROM segments"))
def q_segments(spark, sf):
    """K16."""
    cells, cc = _cohort_customers(spark, sf)
    return CU.segments(cells, cc, P)


# ---------------------------------------------------------------- matrices
from vintage.operators import matrix as MX  # noqa: E402


def _cells(spark, sf):
    """The cell table, written once: every matrix and model query reads it
    several times (pivot values, sizes, splits, k-NN rounds)."""
    return materialize(C.cohort_cells(txn(spark, sf), P))


@register("abs_rates", lambda: with_ctes(O.matrix_ctes(P),
          f"SELECT {_K}, retention_rate_pc, churn_rate_pc, retention_rate_abs_val, churn_rate_abs_val FROM abs_cells"))
def q_abs_rates(spark, sf):
    """K17."""
    return MX.abs_rates(_cells(spark, sf)).select(
        *_K.split(", "), "retention_rate_pc", "churn_rate_pc", "retention_rate_abs_val", "churn_rate_abs_val")


COHORTS = months_between(FIXTURE_FIRST_MONTH, P.as_of)
PERIODS = list(range(len(COHORTS)))


def _register_measure(measure: str, column: str, places: int):
    def piv(spark, sf):
        return MX.pivot(_cells(spark, sf), column, P, PERIODS)
    piv.__doc__ = f"M1 on {column}."
    register(f"pivot_{measure}", lambda: O.pivot_sql(P, column, PERIODS))(piv)

    def piv_t(spark, sf):
        return MX.pivot_t(_cells(spark, sf), column, P, COHORTS)
    piv_t.__doc__ = f"M2 on {column}."
    register(f"pivot_t_{measure}", lambda: O.pivot_t_sql(P, column, COHORTS))(piv_t)

    def heat(spark, sf):
        return MX.heatmap_frame(_cells(spark, sf), measure, P)
    heat.__doc__ = f"K20 for {measure}."
    register(f"heatmap_{measure}", lambda: O.heatmap_sql(P, measure))(heat)


for _m, (_col, _pl) in MX.MEASURES.items():
    _register_measure(_m, _col, _pl)


@register("cohort_size", lambda: O.cohort_size_sql(P, "no_of_customers"))
def q_cohort_size(spark, sf):
    """M3 (customers at the first period)."""
    return MX.cohort_size(_cells(spark, sf), "no_of_customers", P)


@register("cohort_size_ltv", lambda: O.cohort_size_sql(P, "traditional_ltv"))
def q_cohort_size_ltv(spark, sf):
    """M3 as drawn beside the LTV heatmap (first LTV column)."""
    return MX.cohort_size(_cells(spark, sf), "traditional_ltv", P)


@register("curve_retention", lambda: O.curve_sql(P, "retention_rate_pc", 2, None, "%.1f%%"))
def q_curve_retention(spark, sf):
    """K18 + K21."""
    return MX.curve(_cells(spark, sf), "retention_rate_pc", 2, P, None, "%s%%")


@register("curve_ltv", lambda: O.curve_sql(P, "traditional_ltv", 1, P.max_period, "$%.1f"))
def q_curve_ltv(spark, sf):
    """K19 + K21."""
    return MX.curve(_cells(spark, sf), "traditional_ltv", 1, P, P.max_period, "$%s")


# ---------------------------------------------------------------- imputation
from vintage.operators import impute as IM  # noqa: E402


def _register_impute(measure: str):
    def sql(final):
        return lambda: O.impute_sql(P, measure, final)

    def observed_cells(spark, sf):
        return IM.matrix_cells(_cells(spark, sf), measure, P)
    observed_cells.__doc__ = f"M4 ({measure})."
    register(f"observed_cells_{measure}", sql("SELECT * FROM mcells"))(observed_cells)

    def missing(spark, sf):
        return IM.missing_cells(_cells(spark, sf), measure, P)
    missing.__doc__ = f"M5 ({measure})."
    register(f"missing_cells_{measure}", sql("SELECT * FROM miss"))(missing)

    def split_(spark, sf):
        return IM.split(IM.matrix_cells(_cells(spark, sf), measure, P), P)
    split_.__doc__ = f"L1 ({measure})."
    register(f"split_{measure}", sql("SELECT * FROM splitc"))(split_)

    def knn_pred(spark, sf):
        return IM.knn_test_predictions(_cells(spark, sf), measure, P)
    knn_pred.__doc__ = f"L4, L5 with k-NN ({measure})."
    register(f"knn_predict_{measure}", sql("SELECT * FROM test_pred"))(knn_pred)

    def knn_r2(spark, sf):
        return IM.r2(IM.knn_test_predictions(_cells(spark, sf), measure, P))
    knn_r2.__doc__ = f"L6 for k-NN ({measure})."
    register(f"knn_r2_{measure}", sql("SELECT * FROM knn_r2"))(knn_r2)

    def knn_filled(spark, sf):
        return IM.knn_filled(_cells(spark, sf), measure, P)
    knn_filled.__doc__ = f"M6, L11, K22 with k-NN ({measure})."
    register(f"knn_filled_{measure}", sql("SELECT * FROM filled"))(knn_filled)

    def scores(spark, sf):
        return IM.model_scores(_cells(spark, sf), measure, P)
    scores.__doc__ = f"L2, L3, L5, L6, L7 ({measure}); rows-only check."
    register(f"model_scores_{measure}")(scores)

    def tested(spark, sf):
        return IM.test_predictions(_cells(spark, sf), measure, P)
    tested.__doc__ = f"L5: value and prediction of each model for each test cell ({measure}); rows-only check."
    register(f"model_predictions_{measure}")(tested)

    def search(spark, sf):
        return IM.random_search(_cells(spark, sf), measure, P)
    search.__doc__ = f"L8, L9, L10: 100 draws, 3 folds ({measure}); rows-only check."
    register(f"random_search_{measure}")(search)

    def best(spark, sf):
        return IM.best_filled(_cells(spark, sf), measure, P)
    best.__doc__ = f"L11 with the best model ({measure}); rows-only check."
    register(f"best_filled_{measure}")(best)


for _m in IM.MATRIX_MEASURES:
    _register_impute(_m)


# ---------------------------------------------------------------- segmented (scale re-aim)
P_BY_COUNTRY = P.with_(country=None, segment_cols=("country",))


@register("cohort_cells_by_country", lambda: with_ctes(O.full_cells_ctes(P_BY_COUNTRY), "SELECT * FROM cells"))
def q_cohort_cells_by_country(spark, sf):
    """K13 for every country in one plan (``segment_cols``): the country
    joins every partition key, so all cohort tables come from the same
    aggregates and windows."""
    return C.cohort_cells(txn(spark, sf), P_BY_COUNTRY)


@register("segments_by_country", lambda: with_ctes(O.customers_ctes(P_BY_COUNTRY), "SELECT * FROM segments"))
def q_segments_by_country(spark, sf):
    """K16 with thresholds of each country."""
    t = txn(spark, sf)
    cells = materialize(C.cohort_cells(t, P_BY_COUNTRY))
    return CU.segments(cells, CU.cohort_customers(t, cells, P_BY_COUNTRY), P_BY_COUNTRY)


@register("knn_filled_by_country", lambda: O.impute_sql(P_BY_COUNTRY, "retention", "SELECT * FROM filled"))
def q_knn_filled_by_country(spark, sf):
    """M6, L11, K22 with k-NN on the matrix of each country."""
    return IM.knn_filled(materialize(C.cohort_cells(txn(spark, sf), P_BY_COUNTRY)), "retention", P_BY_COUNTRY)


@register("model_scores_by_country")
def q_model_scores_by_country(spark, sf):
    """L2, L3, L5, L6, L7 for the matrix of each country; rows-only check."""
    return IM.model_scores(materialize(C.cohort_cells(txn(spark, sf), P_BY_COUNTRY)), "retention", P_BY_COUNTRY)


@register("best_filled_by_country")
def q_best_filled_by_country(spark, sf):
    """L11 with the best model of each country; rows-only check."""
    return IM.best_filled(materialize(C.cohort_cells(txn(spark, sf), P_BY_COUNTRY)), "retention", P_BY_COUNTRY)


# ---------------------------------------------------------------- all levels of two segments
P_LEVELS = P.with_(country=None, product_type=None)


def _levels_sql() -> str:
    cols = ("country", "product_type")
    parts = []
    for kept in LV.levels(list(cols)):
        own = ", ".join(c if c in kept else f"'{LV.ALL}' AS {c}" for c in cols)
        inner = with_ctes(O.full_cells_ctes(P_LEVELS.with_(segment_cols=kept)), "SELECT * FROM cells")
        parts.append(f"SELECT {own}, {O.CELL_COLUMNS} FROM ({inner})")
    return with_ctes([("levels", "\nUNION ALL\n".join(parts))], "SELECT * FROM levels")


@register("cohort_cells_by_level", _levels_sql)
def q_cohort_cells_by_level(spark, sf):
    """K13 by country and product type, by each, and over all, from one scan
    of each branch."""
    return LV.cells_by_level(txn(spark, sf), P_LEVELS)


@register("cohort_cells_incremental", _full_sql("SELECT * FROM cells"))
def q_cohort_cells_incremental(spark, sf):
    """K13 from a state that three batches were added to: odd customers' rows
    from 1998 on, even customers' ones, then all earlier rows (which move first
    dates) and those without a date. The table is mapped once, not in
    each step of each batch."""
    rows = staged(txn(spark, sf, merge_parts=True).select(*INC.columns(P)))
    late, odd = F.coalesce(F.col("transaction_date") >= "1998-01-01", F.lit(False)), F.coalesce(F.col("customer_id").cast("long") % 2 == 1, F.lit(False))
    state = INC.CohortState(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohorts_{uuid.uuid4().hex[:12]}", P)
    for batch in (late & odd, late & ~odd, ~late):
        state.append(rows.where(batch))
    return state.cells()
