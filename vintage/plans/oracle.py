"""DuckDB oracle SQL for every registered query.

Each query is a self-contained statement over the driver's pre-registered
views (lineitem, orders, customer, nation, part, ...). The CTE chain mirrors
the Spark operators step by step; fragments live in ``sqlfrag``.
"""

from __future__ import annotations

from vintage.params import Params
from vintage.plans.sqlfrag import (
    cols, dbl, exact_sum, ltv_quotient, month_diff, month_start, nan_to_null, part, rnd, stable_avg,
    with_ctes, year_start,
)

CTE = list[tuple[str, str]]


def transactions_ctes() -> CTE:
    """FIXTURES.md §3 mapping; first month per customer as a window so that
    the null customer forms its own group, like the Spark null-safe join."""
    txn0 = """SELECT
  CAST(o.o_orderkey AS VARCHAR) AS transaction_id,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE CAST(o.o_custkey AS VARCHAR) END AS customer_id,
  CASE WHEN o.o_orderkey % 89 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS transaction_date,
  CASE WHEN (l.l_orderkey + l.l_linenumber) % 53 = 0 THEN NULL
       ELSE CAST(round(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))
  END AS transaction_amount,
  CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN -l.l_quantity ELSE l.l_quantity END AS INTEGER) AS quantity,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'one_time' ELSE 'monthly' END AS frequency_of_payment,
  CASE WHEN p.p_type IN ('MEDIUM', 'STANDARD', 'LARGE', 'PROMO') THEN 'fast_moving_consumer_goods' ELSE 'durables' END AS product_type,
  CASE WHEN n.n_regionkey IN (0, 1, 2) THEN 'United Kingdom' ELSE n.n_name END AS country,
  CAST(l.l_partkey AS VARCHAR) AS transaction_item_code,
  p.p_name AS transaction_item_description
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey"""
    txn = f"""SELECT transaction_id, customer_id, transaction_date,
  {month_start("min(transaction_date) OVER (PARTITION BY customer_id)")} AS first_transaction_month,
  transaction_amount, quantity, frequency_of_payment, product_type, country,
  transaction_item_code, transaction_item_description
FROM txn0"""
    return [("txn0", txn0), ("transactions", txn)]


def _lit_date(d: str) -> str:
    return f"DATE '{d}'"


def clean_where(p: Params) -> str:
    conds = ["transaction_id IS NOT NULL", "customer_id IS NOT NULL",
             "transaction_date IS NOT NULL", "first_transaction_month IS NOT NULL"]
    for col, value in p.filters.items():
        conds.append(f"{col} = '{value}'")
    conds.append("quantity > 0")
    return " AND ".join(conds)


def cells_ctes(p: Params) -> CTE:
    """Branch A cells, K3–K7 (→ ``base_cells``)."""
    seg = tuple(p.segment_cols)
    wc = part(seg, "cohort")
    wo = part(seg, "cohort") + " ORDER BY txn_month"
    rows_a = f"""SELECT {cols(seg)}{", " if seg else ""}{month_start("first_transaction_month")} AS cohort,
  {month_start("transaction_date")} AS txn_month, customer_id,
  COALESCE(transaction_amount, CAST(0 AS DECIMAL(18,2))) AS transaction_amount
FROM transactions WHERE {clean_where(p)}{"".join(f" AND {c} IS NOT NULL" for c in seg)}"""
    n = "count(DISTINCT customer_id)" if p.distinct_customers else "count(customer_id)"
    counts = f"""SELECT {cols(seg, "cohort", "txn_month")}, {n} AS no_of_customers,
  sum(transaction_amount) AS revenue_dec, {month_diff("txn_month", "cohort")} AS period_number
FROM rows_a GROUP BY {cols(seg, "cohort", "txn_month")}"""
    n0 = f"max(CASE WHEN period_number = 0 THEN no_of_customers END) OVER ({wc})"
    ret = f"""SELECT *, {rnd(f"(100 * no_of_customers) / {n0}", 2)} AS retention_rate_pc FROM counts"""
    churn = rnd(f"{dbl(100.0)} - retention_rate_pc", 2)
    step2 = f"""SELECT *,
  CASE WHEN {churn} = 0 THEN {dbl(100.0)} ELSE {churn} END AS churn_rate_pc,
  no_of_customers AS active_cust,
  COALESCE(abs(no_of_customers - lag(no_of_customers) OVER ({wo})), no_of_customers) AS lost_cust,
  CAST(revenue_dec AS DOUBLE) AS revenue,
  CAST(sum(revenue_dec) OVER ({wo} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative_revenue
FROM ret"""
    base = f"""SELECT *, {rnd("cumulative_revenue / no_of_customers", 2)} AS avg_revenue_per_user FROM step2"""
    return [("rows_a", rows_a), ("counts", counts), ("ret", ret), ("step2", step2), ("base", base)]


def branch_b_ctes(p: Params) -> CTE:
    first = """SELECT customer_id, min(transaction_date) AS first_transaction_date
FROM transactions WHERE transaction_date IS NOT NULL AND customer_id IS NOT NULL GROUP BY customer_id"""
    rows = f"""SELECT t.*, f.first_transaction_date,
  {year_start("f.first_transaction_date")} AS first_transaction_yr,
  {year_start("t.transaction_date")} AS record_level_transaction_yr,
  {month_start("f.first_transaction_date")} AS cohort,
  {month_start("t.transaction_date")} AS txn_month,
  {month_diff(month_start("t.transaction_date"), month_start("f.first_transaction_date"))} AS period_number
FROM transactions t JOIN first_txn f ON t.customer_id = f.customer_id
WHERE t.transaction_date IS NOT NULL"""
    b = f"""SELECT * FROM rows_b0
WHERE cohort >= {_lit_date(p.min_cohort)} AND cohort < {_lit_date(p.as_of)} AND txn_month <> {_lit_date(p.as_of)}"""
    return [("first_txn", first), ("rows_b0", rows), ("rows_b", b)]


def purchases_ctes(p: Params) -> CTE:
    seg = tuple(p.segment_cols)
    k = cols(seg, "cohort", "txn_month", "period_number")
    purch = f"""SELECT {k}, count(DISTINCT transaction_id) AS total_transactions,
  count(DISTINCT customer_id) AS total_customers,
  {rnd("count(DISTINCT transaction_id) / count(DISTINCT customer_id)", 1)} AS no_of_cust_purchases
FROM rows_b{" WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in seg) if seg else ""} GROUP BY {k}"""
    return [("purch", purch)]


CELL_COLUMNS = (
    "cohort, txn_month, period_number, no_of_customers, retention_rate_pc, churn_rate_pc, "
    "active_cust, lost_cust, revenue, cumulative_revenue, avg_revenue_per_user, total_transactions, "
    "total_customers, no_of_cust_purchases, period_number_for_cltv, retention_rate_for_cltv, "
    "retention_rate_cohort_avg, avg_profit_margin_per_cohort, traditional_ltv")


def full_cells_ctes(p: Params) -> CTE:
    seg = tuple(p.segment_cols)
    wc = part(seg, "cohort")
    wo = part(seg, "cohort") + " ORDER BY txn_month"
    joined = f"""SELECT b.*, u.total_transactions, u.total_customers, u.no_of_cust_purchases
FROM base b LEFT JOIN purch u USING ({cols(seg, "cohort", "txn_month", "period_number")})"""
    nxt = f"""SELECT *, period_number + 1 AS period_number_for_cltv,
  lead(retention_rate_pc) OVER ({wo}) AS next_ret FROM joined"""
    avg = f"""SELECT *, {rnd(stable_avg("next_ret", 2, over=wc), 1)} AS retention_rate_cohort_avg FROM nxt"""
    marg = f"""SELECT *, COALESCE(next_ret, retention_rate_cohort_avg) AS retention_rate_for_cltv,
  (avg_revenue_per_user * {dbl(p.margin_rate)}) * (period_number_for_cltv * no_of_cust_purchases) AS avg_profit_margin_per_cohort
FROM avg_c"""
    ltv = f"""SELECT {cols(seg)}{", " if seg else ""}{CELL_COLUMNS.replace(", traditional_ltv", "")},
  {rnd(nan_to_null(f"avg_profit_margin_per_cohort * {ltv_quotient('retention_rate_for_cltv', p.discount_rate)}"), 1)} AS traditional_ltv
FROM marg"""
    return ([*transactions_ctes(), *cells_ctes(p), *branch_b_ctes(p), *purchases_ctes(p),
             ("joined", joined), ("nxt", nxt), ("avg_c", avg), ("marg", marg), ("cells", ltv)])


# ---------------------------------------------------------------- quantiles / profile
def quantile_sql(src: str, col: str, p: float, where: str = "TRUE") -> str:
    """Scalar subquery: exact quantile with numpy's linear interpolation."""
    q = (float(p) * 100.0) / 100.0
    return f"""(SELECT CASE WHEN t >= 0.5 THEN b - (b - a) * ({dbl(1.0)} - t) ELSE a + (b - a) * t END FROM (
  SELECT CAST(max(CASE WHEN k = lo THEN v END) AS DOUBLE) AS a,
         CAST(max(CASE WHEN k = hi THEN v END) AS DOUBLE) AS b, max(t) AS t FROM (
    SELECT v, k,
      CASE WHEN h >= n - 1 THEN n - 1 ELSE CAST(floor(h) AS BIGINT) END AS lo,
      CASE WHEN h >= n - 1 THEN n - 1 ELSE CAST(floor(h) AS BIGINT) + 1 END AS hi,
      h - floor(h) AS t
    FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS k,
                 count(*) OVER () AS n, (count(*) OVER () - 1) * {dbl(q)} AS h
          FROM {src} WHERE {col} IS NOT NULL AND ({where})))))"""


TXN_TYPES = [
    ("transaction_id", "string"), ("customer_id", "string"), ("transaction_date", "date"),
    ("first_transaction_month", "date"), ("transaction_amount", "decimal(18,2)"), ("quantity", "int"),
    ("frequency_of_payment", "string"), ("product_type", "string"), ("country", "string"),
    ("transaction_item_code", "string"), ("transaction_item_description", "string"),
]


def profile_info_ctes() -> CTE:
    counts = "SELECT count(*) AS _rows, " + ", ".join(f"count({c}) AS {c}" for c, _ in TXN_TYPES) + " FROM transactions"
    rows = "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", {c} AS non_null, '{t}' AS type, _rows FROM counts"
        for i, (c, t) in enumerate(TXN_TYPES))
    return [*transactions_ctes(), ("counts", counts), ("info", rows)]


def head_sql(n: int = 5) -> str:
    order = ", ".join(f"{c} ASC NULLS FIRST" for c, _ in TXN_TYPES)
    return with_ctes(transactions_ctes(), f"SELECT * FROM transactions ORDER BY {order} LIMIT {n}")


def describe_sql(cols_: tuple[str, ...] = ("transaction_amount", "quantity")) -> str:
    parts = []
    for c in cols_:
        s, n = f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)", f"count({c})"
        mid = f"(SELECT CAST(round({s} / count({c}), 2) AS DECIMAL(18,2)) FROM transactions)"
        d = f"(CAST({c} AS DECIMAL(18,2)) - {mid})"
        s1, s2 = f"CAST(sum({d}) AS DOUBLE)", f"CAST(sum({d} * {d}) AS DOUBLE)"
        var = f"(({s2} - ({s1} * {s1}) / {n}) / ({n} - 1))"
        parts.append(f"""SELECT '{c}' AS "column", {n} AS count,
  CASE WHEN {n} > 0 THEN {s} / {n} END AS mean,
  CASE WHEN {n} > 1 THEN {rnd(f"sqrt(greatest({var}, {dbl(0.0)}))", 6)} END AS std,
  CAST(min({c}) AS DOUBLE) AS min,
  {quantile_sql("transactions", c, 0.25)} AS p25,
  {quantile_sql("transactions", c, 0.5)} AS p50,
  {quantile_sql("transactions", c, 0.75)} AS p75,
  CAST(max({c}) AS DOUBLE) AS max
FROM transactions""")
    return with_ctes(transactions_ctes(), "\nUNION ALL\n".join(parts))


CATEGORICAL = ("frequency_of_payment", "product_type", "country")


def approx_customers_sql() -> str:
    dated = ("SELECT strftime(transaction_date, '%Y-%m') AS month, country, customer_id FROM transactions "
             "WHERE transaction_date IS NOT NULL")
    levels = " UNION ALL ".join(
        f"SELECT '{level}' AS level, {key} AS key, count(DISTINCT customer_id) AS n_customers, TRUE AS within_bound "
        f"FROM dated{f' GROUP BY {key}' if level != 'all' else ''}"
        for level, key in (("month", "month"), ("country", "country"), ("all", "'all'")))
    return with_ctes([*transactions_ctes(), ("dated", dated)], levels)


def n_unique_sql() -> str:
    body = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM transactions" for c in CATEGORICAL)
    return with_ctes(transactions_ctes(), body)


def unique_values_sql() -> str:
    body = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n_rows FROM transactions GROUP BY {c}"
        for c in CATEGORICAL)
    return with_ctes(transactions_ctes(), body)


# ---------------------------------------------------------------- customers
ITEM_KEYS = "customer_id, product_type, transaction_item_code, transaction_item_description"
CELL_KEY = "cohort, txn_month, period_number"
CELL_METRICS = [c.strip() for c in CELL_COLUMNS.split(",")][3:]
ZEROED_DOUBLE = ("no_of_cust_purchases", "retention_rate_pc", "retention_rate_for_cltv",
                 "retention_rate_cohort_avg", "churn_rate_pc", "revenue", "cumulative_revenue",
                 "avg_revenue_per_user", "avg_profit_margin_per_cohort", "traditional_ltv")
ZEROED_LONG = ("active_cust", "lost_cust")


def customers_ctes(p: Params) -> CTE:
    seg = tuple(p.segment_cols)
    key = cols(seg, CELL_KEY)
    own = "".join(f"{c}, " for c in seg)
    prof = f"""SELECT {key}, {ITEM_KEYS},
  count(DISTINCT transaction_id) AS transaction_id,
  CAST(COALESCE(sum(quantity), 0) AS BIGINT) AS quantity,
  CAST(COALESCE(sum(transaction_amount), 0) AS DOUBLE) AS transaction_amount
FROM rows_b
WHERE customer_id IS NOT NULL AND product_type IS NOT NULL AND transaction_item_code IS NOT NULL
  AND transaction_item_description IS NOT NULL
GROUP BY {key}, {ITEM_KEYS}"""
    rn = f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ITEM_KEYS}) AS RN FROM prof"""
    sel = []
    for c in CELL_METRICS:
        if c in ZEROED_DOUBLE:
            sel.append(f"CASE WHEN r.RN = 1 THEN c.{c} ELSE {dbl(0.0)} END AS {c}")
        elif c in ZEROED_LONG:
            sel.append(f"CASE WHEN r.RN = 1 THEN c.{c} ELSE CAST(0 AS BIGINT) END AS {c}")
        elif c == "total_customers":
            sel.append("COALESCE(CASE WHEN r.RN = 1 THEN c.no_of_customers ELSE c.total_customers END, 0) AS total_customers")
        elif c == "total_transactions":
            sel.append("COALESCE(c.total_transactions, 0) AS total_transactions")
        else:
            sel.append(f"c.{c}")
    attributed = f"""SELECT r.*, {", ".join(sel)},
  CASE WHEN r.RN = 1 THEN COALESCE(c.total_customers, 0) ELSE 0 END AS total_acquired_customers
FROM prof_rn r LEFT JOIN cells c USING ({key})"""
    cc0 = f"""SELECT {key}, customer_id, min(traditional_ltv) AS cltv_interim
FROM attributed GROUP BY {key}, customer_id"""
    cc = f"""SELECT k.{key.replace(", ", ", k.")}, k.customer_id, k.cltv_interim,
  {", ".join("c." + m for m in CELL_METRICS)}, 1 AS ltv_flag
FROM cc0 k LEFT JOIN cells c USING ({key}) WHERE c.traditional_ltv IS NOT NULL"""
    cust = f"""SELECT {own}customer_id, max(cohort) AS cohort, max(period_number) AS period_number,
  max(traditional_ltv) AS traditional_ltv FROM cohort_customers GROUP BY {own}customer_id"""
    same = " AND ".join(f"{c} = s.{c}" for c in seg) or "TRUE"
    q = lambda src, at: quantile_sql(src, "traditional_ltv", at, same)
    th = f"""SELECT {own}{q("cells", 0.5)} AS cells_q50, {q("cells", 0.8)} AS cells_q80,
  {q("customers_ltv", 0.5)} AS customers_q50, {q("customers_ltv", 0.8)} AS customers_q80
{f"FROM (SELECT DISTINCT {own[:-2]} FROM cells) s" if seg else ""}"""
    segs = f"""SELECT u.*, CASE WHEN u.traditional_ltv < t.cells_q50 THEN 'low_cltv'
  WHEN t.customers_q50 <= u.traditional_ltv AND u.traditional_ltv < t.customers_q80 THEN 'medium_cltv'
  WHEN u.traditional_ltv >= t.cells_q80 THEN 'high_cltv' ELSE 'unknown' END AS traditional_ltv_segments
FROM customers_ltv u {f"LEFT JOIN thresholds t USING ({own[:-2]})" if seg else ", thresholds t"}"""
    return [*full_cells_ctes(p), ("prof", prof), ("prof_rn", rn), ("attributed", attributed),
            ("cc0", cc0), ("cohort_customers", cc), ("customers_ltv", cust), ("thresholds", th),
            ("segments", segs)]


# ---------------------------------------------------------------- matrices
MEASURES = {
    "retention": ("retention_rate_pc", 2),
    "churn": ("churn_rate_pc", 2),
    "ltv": ("traditional_ltv", 1),
    "active": ("active_cust", 0),
    "lost": ("lost_cust", 0),
}


def matrix_ctes(p: Params) -> CTE:
    ab = f"""SELECT *, retention_rate_pc / {dbl(100.0)} AS retention_rate_abs_val,
  churn_rate_pc / {dbl(100.0)} AS churn_rate_abs_val FROM cells"""
    return [*full_cells_ctes(p), ("abs_cells", ab)]


def obs_sql(value: str, seg: tuple[str, ...] = ()) -> str:
    return (f"SELECT {''.join(f'{c}, ' for c in seg)}strftime(cohort, '%Y-%m') AS cohort, period_number, {value} AS value "
            f"FROM abs_cells WHERE {value} IS NOT NULL")


def pivot_sql(p: Params, value: str, periods: list[int]) -> str:
    wide = ", ".join(f'avg(value) FILTER (WHERE period_number = {k}) AS "{k}"' for k in periods)
    return with_ctes(matrix_ctes(p), f"SELECT cohort, {wide} FROM ({obs_sql(value)}) GROUP BY cohort")


def pivot_t_sql(p: Params, value: str, cohorts: list[str]) -> str:
    wide = ", ".join(f"avg(value) FILTER (WHERE cohort = '{c}') AS \"{c}\"" for c in cohorts)
    return with_ctes(matrix_ctes(p), f"SELECT period_number, {wide} FROM ({obs_sql(value)}) GROUP BY period_number")


def cohort_size_ctes(p: Params, value: str, name: str = "size") -> CTE:
    o = f"obs_{name}"
    sz = f"""SELECT r.cohort, a.value AS cohort_size
FROM (SELECT DISTINCT cohort FROM {o}) r
LEFT JOIN (SELECT cohort, value FROM {o} WHERE period_number = (SELECT min(period_number) FROM {o})) a
USING (cohort)"""
    return [(o, obs_sql(value)), (name, sz)]


def cohort_size_sql(p: Params, value: str) -> str:
    return with_ctes([*matrix_ctes(p), *cohort_size_ctes(p, value)], "SELECT * FROM size")


def curve_sql(p: Params, value: str, places: int, max_period: int | None, fmt: str | None) -> str:
    where = f"WHERE period_number <= {max_period}" if max_period is not None else ""
    y = stable_avg(value, places)
    lab = f", CASE WHEN {y} IS NOT NULL THEN printf('{fmt}', {y}) END AS label" if fmt else ""
    return with_ctes(matrix_ctes(p),
                     f"SELECT period_number, {y} AS {value}{lab} FROM abs_cells {where} GROUP BY period_number")


def heatmap_sql(p: Params, measure: str) -> str:
    col, _ = MEASURES[measure]
    if measure in ("retention", "churn"):
        col = col.replace("_pc", "_abs_val")
        lab = f"printf('%.0f%%', round_even(value * {dbl(100.0)}, 0))"
    else:
        lab = "printf('%.1f', CAST(value AS DOUBLE))"
    size_col = "traditional_ltv" if measure == "ltv" else "no_of_customers"
    ctes = [*matrix_ctes(p), ("obs_m", obs_sql(col)), *cohort_size_ctes(p, size_col)]
    return with_ctes(ctes, f"SELECT o.cohort, o.period_number, o.value, {lab} AS label, s.cohort_size, "
                           f"printf('%g', CAST(s.cohort_size AS DOUBLE)) AS size_label "
                           f"FROM obs_m o LEFT JOIN size s USING (cohort)")


# ---------------------------------------------------------------- imputation
MATRIX_MEASURES = {"retention": ("retention_rate_abs_val", 4), "ltv": ("traditional_ltv", 1)}


def impute_ctes(p: Params, measure: str) -> CTE:
    value, places = MATRIX_MEASURES[measure]
    seg = tuple(p.segment_cols)
    own = "".join(f"{c}, " for c in seg)
    by = f"PARTITION BY {own[:-2]} " if seg else ""
    at = cols(seg, "row_idx", "col_idx")

    def same(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{c} = {b}.{c}" for c in seg) or "TRUE"

    ridx = f"""SELECT {own}cohort, CAST(dense_rank() OVER ({by}ORDER BY cohort) - 1 AS INTEGER) AS row_idx
FROM (SELECT DISTINCT {own}cohort FROM obs_i)"""
    cidx = f"""SELECT {own}period_number, CAST(dense_rank() OVER ({by}ORDER BY period_number) - 1 AS INTEGER) AS col_idx
FROM (SELECT DISTINCT {own}period_number FROM obs_i)"""
    mcells = f"""SELECT {at}, cohort, period_number, value
FROM obs_i JOIN ridx USING ({cols(seg, "cohort")}) JOIN cidx USING ({cols(seg, "period_number")})"""
    miss = f"""SELECT {"".join(f"r.{c}, " for c in seg)}r.row_idx, c.col_idx, r.cohort, c.period_number FROM ridx r JOIN cidx c ON {same("r", "c")}
WHERE NOT EXISTS (SELECT 1 FROM mcells m WHERE m.row_idx = r.row_idx AND m.col_idx = c.col_idx AND {same("m", "r")})"""
    splitc = f"""SELECT *, ((row_idx * 31 + col_idx * 17 + {p.split_seed}) % {p.split_mod}) = 0 AS is_test FROM mcells"""

    def knn(query: str) -> str:
        mine = "".join(f"q.{c}, " for c in seg)
        return f"""SELECT {at}, {stable_avg("value", places)} AS prediction FROM (
  SELECT {mine}q.row_idx, q.col_idx, t.value,
    row_number() OVER (PARTITION BY {mine}q.row_idx, q.col_idx
      ORDER BY (t.row_idx - q.row_idx) * (t.row_idx - q.row_idx) + (t.col_idx - q.col_idx) * (t.col_idx - q.col_idx),
               t.row_idx, t.col_idx) AS rk
  FROM {query} q JOIN (SELECT * FROM splitc WHERE NOT is_test) t ON {same("q", "t")})
WHERE rk <= {p.knn_k} GROUP BY {at}"""
    test_pred = f"""SELECT s.*, k.prediction FROM splitc s LEFT JOIN knn_t k USING ({at}) WHERE s.is_test"""
    r2 = f"""SELECT 1.0::DOUBLE - {exact_sum("res")} / {exact_sum("tot")} AS r2
FROM (SELECT (value - prediction) * (value - prediction) AS res, (value - ybar) * (value - ybar) AS tot
      FROM (SELECT *, (SELECT {exact_sum("value")} / count(*) FROM test_pred WHERE prediction IS NOT NULL) AS ybar
            FROM test_pred WHERE prediction IS NOT NULL))"""
    filled = f"""SELECT *, CASE WHEN value IS NOT NULL THEN printf('%.2f', value) END AS label FROM (
SELECT {at}, cohort, period_number, value, FALSE AS is_predicted FROM mcells
UNION ALL
SELECT {at}, m.cohort, m.period_number, k.prediction AS value, TRUE AS is_predicted
FROM miss m LEFT JOIN knn_m k USING ({at}))"""
    return [*matrix_ctes(p), ("obs_i", obs_sql(value, seg)), ("ridx", ridx), ("cidx", cidx),
            ("mcells", mcells), ("miss", miss), ("splitc", splitc),
            ("knn_t", knn("(SELECT * FROM splitc WHERE is_test)")), ("test_pred", test_pred),
            ("knn_r2", r2), ("knn_m", knn("miss")), ("filled", filled)]


def impute_sql(p: Params, measure: str, final: str) -> str:
    return with_ctes(impute_ctes(p, measure), final)
