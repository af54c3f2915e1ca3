"""Run parameters.

Every literal the analysis depends on lives here so that a run is reproducible
and the same plan serves any data set (the reference hard-codes them inline).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace


# Fixed values of the analysis (must equal the reference's for the same results):
#   payment frequency kept: "monthly"
#   product type kept:      "fast_moving_consumer_goods"
#   country kept:           "United Kingdom"
#   smallest cohort kept:   2009-12
#   profit margin rate:     0.2
#   discount rate:          0.04
#   periods on the LTV curve: 0 .. 10
#   k of the nearest-neighbour regressor: 5
#   train/test split: 20 % test, seed 42
#   forest: 100 trees, seed 42
REFERENCE_FREQUENCY = "monthly"
REFERENCE_PRODUCT_TYPE = "fast_moving_consumer_goods"
REFERENCE_COUNTRY = "United Kingdom"
REFERENCE_MIN_COHORT = "2009-12-01"
MARGIN_RATE = 0.2
DISCOUNT_RATE = 0.04
CURVE_MAX_PERIOD = 10
KNN_K = 5
TEST_FRACTION_MOD = 5  # one cell in five goes to the test side
SPLIT_SEED = 42
FOREST_TREES = 100
MODEL_SEED = 42


def _this_month() -> str:
    today = _dt.date.today()
    return f"{today.year:04d}-{today.month:02d}-01"


@dataclass(frozen=True)
class Params:
    """Knobs of one analysis run.

    ``filters`` maps a column to the single value kept by the branch-A
    cleaning step (an equality conjunction); ``None`` disables a filter.
    ``segment_cols`` adds partition keys to every cohort computation so that
    many independent cohort tables (e.g. one per country) come out of one plan;
    the empty tuple reproduces the reference.
    """

    frequency: str | None = REFERENCE_FREQUENCY
    product_type: str | None = REFERENCE_PRODUCT_TYPE
    country: str | None = REFERENCE_COUNTRY
    min_cohort: str = REFERENCE_MIN_COHORT
    as_of: str = field(default_factory=_this_month)
    margin_rate: float = MARGIN_RATE
    discount_rate: float = DISCOUNT_RATE
    max_period: int = CURVE_MAX_PERIOD
    segment_cols: tuple[str, ...] = ()
    distinct_customers: bool = False
    knn_k: int = KNN_K
    split_mod: int = TEST_FRACTION_MOD
    split_seed: int = SPLIT_SEED

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @property
    def filters(self) -> dict[str, str]:
        out = {}
        if self.frequency is not None:
            out["frequency_of_payment"] = self.frequency
        if self.product_type is not None:
            out["product_type"] = self.product_type
        if self.country is not None:
            out["country"] = self.country
        return out


# Parameters for the driver-table mapping (FIXTURES.md §3): its dates run from
# 1995-01 to 2001-08, so the cohort floor and the run month move with them.
FIXTURE_PARAMS = Params(min_cohort="1995-02-01", as_of="2001-08-01")
FIXTURE_FIRST_MONTH = "1995-01-01"


def months_between(first: str, last: str) -> list[str]:
    """Labels (YYYY-MM) of all months from ``first`` to ``last``."""
    y, m = map(int, first.split("-")[:2])
    out = []
    while (label := f"{y:04d}-{m:02d}") <= last[:7]:
        out.append(label)
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out
