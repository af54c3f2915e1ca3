"""Cell tables of all levels against separate runs of each."""

import contextlib
import io
import random
import re

import pytest
from conftest import GOLDEN_PARAMS, F_, M, SF, make_txn
from pyspark.sql import functions as F

from vintage.operators import cells as C
from vintage.operators import levels as LV
from vintage.plans.catalog import REGISTRY

P = GOLDEN_PARAMS.with_(country=None, product_type=None)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def txn(spark):
    rng = random.Random(9)
    rows = [(f"t{i % 170}", f"c{rng.randrange(25)}", f"2010-{1 + rng.randrange(6):02d}-{1 + rng.randrange(20):02d}", f"2010-0{1 + rng.randrange(3)}-01",
             rng.choice([None, 10, 25]), M, rng.choice([F_, "durables", None]), rng.choice(["France", "Spain", None]), rng.choice([1, 2, -1]), "i1")
            for i in range(400)]
    return make_txn(spark, rows)


def test_levels_equal_separate_runs(txn):
    got = LV.cells_by_level(txn, P)
    want = None
    for kept in LV.levels(["country", "product_type"]):
        one = C.cohort_cells(txn, P.with_(segment_cols=kept))
        one = one.select(*[(F.col(c) if c in kept else F.lit(LV.ALL)).alias(c) for c in ("country", "product_type")], *C.CELL_COLUMNS)
        want = one if want is None else want.unionByName(one)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    assert {(r.country == LV.ALL, r.product_type == LV.ALL) for r in got.collect()} == {(a, b) for a in (False, True) for b in (False, True)}


def test_levels_of_one_column_and_of_nothing(txn):
    by = LV.cells_by_level(txn, P, ("country",))
    assert {r.country for r in by.select("country").distinct().collect()} == {"France", "Spain", LV.ALL}
    assert LV.cells_by_level(txn.limit(0), P).count() == 0
    with pytest.raises(ValueError):
        LV.cells_by_level(txn, GOLDEN_PARAMS)


def test_states_are_read_once(spark):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        REGISTRY["cohort_cells_by_level"][0](spark, SF).explain("formatted")
    scans = buf.getvalue().count("lineitem.parquet")
    assert "Expand" in buf.getvalue() and scans <= 8, scans  # not 4 x the scans of one level


def test_no_transaction_moves_once_per_level(spark, txn):
    """Only transactions of several customers meet by segment and transaction,
    and those have their cohort; the others are counted inside their sets."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        LV.cells_by_level(txn, P).explain("formatted")
    dealt = re.findall(r"hashpartitioning\(([^\n]*)", buf.getvalue())
    assert dealt and all("cohort" in x for x in dealt if "transaction_id" in x and "country" in x)


def test_first_months_join_at_order_grain(spark):
    """No exchange deals the lines out by customer to give them a first month."""
    buf = io.StringIO()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with contextlib.redirect_stdout(buf):
            REGISTRY["transactions"][0](spark, SF).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [b for b in buf.getvalue().split("\n\n") if ") Exchange" in b.partition("\n")[0] and "quantity" in b]
    assert len(moved) == 2, moved  # by part, by order
