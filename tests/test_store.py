"""The table kept by customer: no exchange, hot customers apart, same rows."""

import contextlib
import io
import re

import pytest
from conftest import GOLDEN_PARAMS as P
from conftest import F_, M, SF, UK, make_txn
from pyspark.sql import functions as F

from vintage.operators import clean as K
from vintage.sources import store as ST
from vintage.sources import transactions_from_tables
from vintage.sources.store import write_customer_store


def plan_of(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def txn(spark):
    rows = [(f"t{i}", None if i % 5 == 0 else "hot" if i % 5 < 3 else f"c{i % 400}", f"2010-{1 + i % 9:02d}-0{1 + i % 8}", "2010-01-01", 10, M, F_, UK, 1, "i1")
            for i in range(3000)]
    return make_txn(spark, rows)


@pytest.fixture(scope="module")
def store(spark, txn, tmp_path_factory):
    return write_customer_store(txn, "store_test", str(tmp_path_factory.mktemp("store")), 4)


def test_rows_apart(store, txn):
    assert {r.customer_id for r in store.apart.select("customer_id").distinct().collect()} == {None, "hot"}
    assert store.rows().exceptAll(txn).count() == 0 and store.rows().count() == txn.count()
    sizes = [r["count"] for r in store.bucketed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


def test_same_results(store, txn):
    for got, want in ((store.first_transactions(), K.first_transaction(txn)), (store.branch_b(P), K.branch_b(txn, P))):
        want = want.select(*got.columns)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_bucketed_customers_need_no_exchange(spark, store):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        first = K.first_transaction(store.bucketed)
        joined = K.branch_b_rows(K.dated(store.bucketed, P), first, P, split=False)
        for df in (first, joined):
            assert not re.search(r"\) Exchange", plan_of(df))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_table(spark, txn, tmp_path):
    store = write_customer_store(txn.limit(0), "store_empty", str(tmp_path), 2)
    assert store.rows().count() == 0 and store.first_transactions().count() == 0 and store.branch_b(P).count() == 0


def test_written_in_one_pass(spark, store, txn, tmp_path):
    """A row is computed once to find the heavy customers and once to be
    written, whichever table it goes to."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    write_customer_store(txn.mapInArrow(count, txn.schema), "store_once", str(tmp_path), 4)
    assert seen.value == 2 * txn.count()
    assert spark.table("store_once_apart").count() == store.apart.count()


def test_buckets_follow_the_input(spark, monkeypatch):
    rows = transactions_from_tables(spark, SF)
    assert ST.buckets_for(rows) == 16
    monkeypatch.setattr(ST, "BUCKET_BYTES", 1_000)
    assert ST.buckets_for(rows) > 16
