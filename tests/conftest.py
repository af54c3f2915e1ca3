import datetime as dt
import decimal
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vintage.params import Params  # noqa: E402
from vintage.session import local_session  # noqa: E402
from vintage.sources.transactions import TXN_SCHEMA  # noqa: E402

SF = os.environ.get("VINTAGE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="vintage-tests")
    yield s


GOLDEN_PARAMS = Params(min_cohort="2009-12-01", as_of="2011-01-01")

M, F_, UK = "monthly", "fast_moving_consumer_goods", "United Kingdom"


def d(s):
    return None if s is None else dt.date.fromisoformat(s)


def amt(x):
    return None if x is None else decimal.Decimal(str(x)).quantize(decimal.Decimal("0.01"))


# FIXTURES.md §4: txn, customer, date, first month, amount, freq, product, country, qty, item
GOLDEN_ROWS = [
    ("t1", "c1", "2010-01-05", "2010-01-01", 100, M, F_, UK, 2, "i1"),
    ("t2", "c2", "2010-01-20", "2010-01-01", 50, M, F_, UK, 1, "i2"),
    ("t3", "c1", "2010-02-03", "2010-01-01", None, M, F_, UK, 1, "i1"),
    ("t4", "c2", "2010-02-10", "2010-01-01", 30, M, F_, UK, 3, "i1"),
    ("t5", "c1", "2010-04-01", "2010-01-01", 40, M, F_, UK, 1, "i1"),
    ("t5", "c1", "2010-04-01", "2010-01-01", 15, M, F_, UK, 1, "i2"),
    ("t6", "c2", "2010-04-09", "2010-01-01", 25, M, F_, UK, 2, "i1"),
    ("t7", "c3", "2010-02-11", "2010-02-01", 60, "one_time", F_, UK, 1, "i1"),
    ("t8", "c3", "2010-03-11", "2010-02-01", 70, M, F_, UK, 1, "i1"),
    ("t9", "c4", "2010-03-02", "2010-03-01", 80, M, F_, UK, 1, "i3"),
    ("t10", "c6", "2010-01-15", "2010-01-01", 90, M, F_, "France", 1, "i1"),
    ("t11", "c1", "2010-01-25", "2010-01-01", -100, M, F_, UK, -2, "i1"),
    ("t12", None, "2010-01-06", "2010-01-01", 10, M, F_, UK, 1, "i1"),
    ("t13", "c2", None, "2010-01-01", 10, M, F_, UK, 1, "i1"),
    ("t14", "c2", "2010-02-20", "2010-01-01", 5, M, "durables", UK, 1, "i4"),
]


def make_txn(spark, rows):
    data = [(t, c, d(dd), d(fm), amt(a), q, fr, pt, co, it, None if it is None else f"desc {it}")
            for (t, c, dd, fm, a, fr, pt, co, q, it) in rows]
    return spark.createDataFrame(data, TXN_SCHEMA)


@pytest.fixture(scope="session")
def golden(spark):
    return make_txn(spark, GOLDEN_ROWS)
