"""FIXTURES.md §4: the 15-transaction golden fixture, one row per trap."""

import datetime as dt

from conftest import GOLDEN_PARAMS as P
from vintage.operators import cells as C
from vintage.operators import customers as CU
from vintage.operators import matrix as MX

D = dt.date

# cohort, month, period, n, retention, churn, lost, revenue, cumulative, ARPU, txns, customers,
# purchases, r, avg, margin, LTV
EXPECTED_CELLS = [
    (D(2010, 1, 1), D(2010, 1, 1), 0, 2, 100.0, 100.0, 2, 150.0, 150.0, 75.0, 4, 3, 1.3, 100.0, 125.0, 19.5, 487.5),
    (D(2010, 1, 1), D(2010, 2, 1), 1, 2, 100.0, 100.0, 0, 30.0, 180.0, 90.0, 3, 2, 1.5, 150.0, 125.0, 54.0, -176.1),
    (D(2010, 1, 1), D(2010, 4, 1), 3, 3, 150.0, -50.0, 1, 80.0, 260.0, 86.67, 2, 2, 1.0, 125.0, 125.0, 69.336, -412.7),
    (D(2010, 2, 1), D(2010, 3, 1), 1, 1, None, None, 1, 70.0, 70.0, 70.0, 1, 1, 1.0, None, None, 28.0, None),
    (D(2010, 3, 1), D(2010, 3, 1), 0, 1, 100.0, 100.0, 1, 80.0, 80.0, 80.0, 1, 1, 1.0, None, None, 16.0, None),
]
COLS = ["cohort", "txn_month", "period_number", "no_of_customers", "retention_rate_pc", "churn_rate_pc",
        "lost_cust", "revenue", "cumulative_revenue", "avg_revenue_per_user", "total_transactions",
        "total_customers", "no_of_cust_purchases", "retention_rate_for_cltv", "retention_rate_cohort_avg",
        "avg_profit_margin_per_cohort", "traditional_ltv"]


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return abs(a - b) < 1e-9
    return a == b


def test_cells(golden):
    got = C.cohort_cells(golden, P).orderBy("cohort", "txn_month").select(*COLS).collect()
    assert len(got) == len(EXPECTED_CELLS)
    for row, exp in zip(got, EXPECTED_CELLS):
        for c, e in zip(COLS, exp):
            assert close(row[c], e), (c, row[c], e, row)


def test_invariants(golden):
    cells = C.cohort_cells(golden, P).collect()
    for r in cells:
        if r.period_number == 0:
            assert r.retention_rate_pc in (100.0, None)
    by = {}
    for r in cells:
        by.setdefault(r.cohort, []).append(r)
    for rows in by.values():
        last = max(rows, key=lambda x: x.txn_month)
        assert abs(last.cumulative_revenue - sum(x.revenue for x in rows)) < 1e-9


def test_profile_and_attribution(golden):
    cells = C.cohort_cells(golden, P)
    prof = CU.customer_profile(golden, cells, P).collect()
    assert len(prof) == 12
    key = {(r.cohort, r.txn_month, r.customer_id, r.transaction_item_code): r for r in prof}
    r = key[(D(2010, 1, 1), D(2010, 1, 1), "c1", "i1")]
    assert (r.transaction_id, r.quantity, r.transaction_amount, r.RN) == (2, 0, 0.0, 1)
    assert (r.total_acquired_customers, r.total_customers, r.total_transactions) == (3, 2, 4)
    assert (r.traditional_ltv, r.revenue, r.retention_rate_pc) == (487.5, 150.0, 100.0)
    r = key[(D(2010, 1, 1), D(2010, 1, 1), "c6", "i1")]
    assert (r.RN, r.total_acquired_customers, r.total_customers, r.total_transactions) == (3, 0, 3, 4)
    assert (r.traditional_ltv, r.revenue, r.retention_rate_pc) == (0.0, 0.0, 0.0)
    r = key[(D(2010, 1, 1), D(2010, 2, 1), "c1", "i1")]
    assert (r.transaction_amount, r.RN, r.traditional_ltv, r.revenue) == (0.0, 1, -176.1, 30.0)
    r = key[(D(2010, 1, 1), D(2010, 2, 1), "c2", "i4")]
    assert r.RN == 2
    r = key[(D(2010, 2, 1), D(2010, 2, 1), "c3", "i1")]
    assert (r.RN, r.total_acquired_customers, r.total_customers, r.total_transactions) == (1, 0, 0, 0)
    assert r.traditional_ltv is None and r.revenue is None
    r = key[(D(2010, 2, 1), D(2010, 3, 1), "c3", "i1")]
    assert (r.total_acquired_customers, r.total_customers, r.total_transactions, r.revenue) == (1, 1, 1, 70.0)
    r = key[(D(2010, 3, 1), D(2010, 3, 1), "c4", "i3")]
    assert (r.revenue, r.retention_rate_pc, r.traditional_ltv) == (80.0, 100.0, None)


def test_cohort_customers_matches_literal_definition(golden):
    cells = C.cohort_cells(golden, P)
    rows_b = golden
    cc = {(r.txn_month, r.customer_id): (r.traditional_ltv, r.cltv_interim)
          for r in CU.cohort_customers(rows_b, cells, P).collect()}
    assert cc == {
        (D(2010, 1, 1), "c1"): (487.5, 487.5), (D(2010, 1, 1), "c2"): (487.5, 0.0),
        (D(2010, 1, 1), "c6"): (487.5, 0.0), (D(2010, 2, 1), "c1"): (-176.1, -176.1),
        (D(2010, 2, 1), "c2"): (-176.1, 0.0), (D(2010, 4, 1), "c1"): (-412.7, -412.7),
        (D(2010, 4, 1), "c2"): (-412.7, 0.0)}
    # the shortcut (no RN) equals min over the attributed profile rows
    prof = CU.customer_profile(rows_b, cells, P).collect()
    lit = {}
    for r in prof:
        k = (r.txn_month, r.customer_id)
        if r.traditional_ltv is not None:
            lit[k] = min(lit.get(k, r.traditional_ltv), r.traditional_ltv)
    for k, (_, interim) in cc.items():
        assert lit[k] == interim


def test_segments_and_thresholds(golden):
    cells = C.cohort_cells(golden, P)
    cc = CU.cohort_customers(golden, cells, P)
    th = CU.ltv_thresholds(cells, CU.customer_ltv(cc, P)).first()
    assert abs(th.cells_q50 - (-176.1)) < 1e-9 and abs(th.cells_q80 - 222.06) < 1e-9
    assert th.customers_q50 == 487.5 and th.customers_q80 == 487.5
    seg = {r.customer_id: (r.cohort, r.period_number, r.traditional_ltv, r.traditional_ltv_segments)
           for r in CU.segments(cells, cc, P).collect()}
    assert seg == {"c1": (D(2010, 1, 1), 3, 487.5, "high_cltv"),
                   "c2": (D(2010, 1, 1), 3, 487.5, "high_cltv"),
                   "c6": (D(2010, 1, 1), 0, 487.5, "high_cltv")}


def test_pivots(golden):
    cells = C.cohort_cells(golden, P)
    ret = MX.pivot(cells, "retention_rate_pc", P)
    assert sorted(r.cohort for r in ret.collect()) == ["2010-01", "2010-03"]
    ltv = MX.pivot(cells, "traditional_ltv", P)
    assert [r.cohort for r in ltv.collect()] == ["2010-01"]
    assert sorted(c for c in ltv.columns if c != "cohort") == ["0", "1", "3"]
    size = {r.cohort: r.cohort_size for r in MX.cohort_size(cells, "no_of_customers", P).collect()}
    assert size == {"2010-01": 2, "2010-02": None, "2010-03": 1}
