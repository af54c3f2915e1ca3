from conftest import SF
from vintage.operators import cells as C
from vintage.operators.impute import SEARCH_SPACE, best_filled, search_draws
from vintage.params import FIXTURE_PARAMS as P
from vintage.session import materialize
from vintage.sources import transactions_from_tables


def test_search_space_size():
    n = 1
    for v in SEARCH_SPACE.values():
        n *= len(v)
    assert n == 540


def test_draws_are_seeded_and_distinct():
    draws = search_draws(100, 42)
    assert draws == search_draws(100, 42) and len({tuple(d.values()) for d in draws}) == 100
    assert len(search_draws(10_000)) == 540


def test_best_filled_covers_grid(spark):
    cells = materialize(C.cohort_cells(transactions_from_tables(spark, SF), P))
    f = best_filled(cells, "ltv", P).collect()
    rows = {r.row_idx for r in f}
    cols = {r.col_idx for r in f}
    assert len(f) == len(rows) * len(cols)
    assert len({(r.row_idx, r.col_idx) for r in f}) == len(f)
