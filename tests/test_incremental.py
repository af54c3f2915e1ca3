"""Cohort state after each batch against one run over all rows so far."""

import random
import re

import pytest
from conftest import GOLDEN_PARAMS as P
from conftest import F_, M, SF, UK, make_txn

from vintage.operators import cells as C
from vintage.operators.incremental import CohortState
from vintage.params import FIXTURE_PARAMS
from vintage.plans import catalog
from vintage.sources import transactions_from_tables


def rows_of(df):
    return sorted(map(str, df.collect()))


def batch(rng, n, months, customers=25):
    return [(f"t{rng.randrange(150)}" if rng.random() > 0.05 else None, f"c{rng.randrange(customers)}" if rng.random() > 0.05 else None,
             f"2010-{rng.choice(months):02d}-{1 + rng.randrange(28):02d}" if rng.random() > 0.05 else None, f"2010-0{1 + rng.randrange(3)}-01",
             rng.choice([None, 10, 25]), M, rng.choice([F_, "durables"]), rng.choice([UK, "France"]), rng.choice([1, 2, -1]), "i1") for _ in range(n)]


def test_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(8)
    batches = [batch(rng, 120, [5, 6]), batch(rng, 60, [7]), batch(rng, 90, [2, 3, 6, 8]), [], batch(rng, 40, [1, 9], 60)]
    batches.append(batches[1][:30])  # the same rows once more
    state, so_far = CohortState(spark, str(tmp_path), P), []
    assert state.cells().count() == 0
    for rows in batches:
        so_far += rows
        state.append(make_txn(spark, rows))
        assert rows_of(state.cells()) == rows_of(C.cohort_cells(make_txn(spark, so_far), P))
    again = CohortState(spark, str(tmp_path), P, batches=len(batches))
    assert rows_of(again.cells()) == rows_of(state.cells())


def test_a_new_month_touches_its_cells_only(spark, tmp_path):
    rows = lambda month, n=8: [(f"t{month}{c}", f"c{c}", f"2010-{month:02d}-03", "2010-02-01", 5, M, F_, UK, 1, "i1") for c in range(n)]
    state = CohortState(spark, str(tmp_path), P)
    for month in (2, 3):
        state.append(make_txn(spark, rows(month)))
    touched = {(str(r.cohort), str(r.txn_month)) for r in state.append(make_txn(spark, rows(4))).collect()}
    assert touched == {("2010-02-01", "2010-04-01")}
    # an earlier first date of one customer moves all that customer's months
    early = state.append(make_txn(spark, [("t0", "c0", "2010-01-09", "2010-02-01", 5, M, F_, UK, 1, "i1")]))
    months = ["2010-01-01", "2010-02-01", "2010-03-01", "2010-04-01"]
    assert {(str(r.cohort), str(r.txn_month)) for r in early.collect()} == {(c, m) for c in ("2010-01-01", "2010-02-01") for m in months}


def test_a_failed_batch_is_appended_again(spark, tmp_path):
    rng = random.Random(3)
    one, two = batch(rng, 50, [4, 5]), batch(rng, 50, [3, 6])
    state = CohortState(spark, str(tmp_path), P)
    state.append(make_txn(spark, one))
    state.append(make_txn(spark, two[:20]))  # as if it had stopped there
    state = CohortState(spark, str(tmp_path), P, batches=1)
    state.append(make_txn(spark, two))
    assert rows_of(state.cells()) == rows_of(C.cohort_cells(make_txn(spark, one + two), P))


def test_segments_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        CohortState(spark, str(tmp_path), P.with_(segment_cols=("country",)))


def test_rows_of_a_batch_are_asked_for_twice(spark, tmp_path):
    """An input that is a plan of its own isn't run again in each step."""
    asked = spark.sparkContext.accumulator(0)

    def counted(part):
        asked.add(1)
        return part

    rng = random.Random(5)
    state = CohortState(spark, str(tmp_path), P)
    for months in ([5, 6], [2, 6, 7]):
        rows = make_txn(spark, batch(rng, 60, months)).coalesce(1)
        before = asked.value
        state.append(spark.createDataFrame(rows.rdd.mapPartitions(counted), rows.schema))
        assert asked.value - before == 2


def test_files_grow_with_months_and_not_with_tasks(spark, tmp_path):
    rng = random.Random(6)
    months = [1, 2, 3, 4, 5, 6]
    state = CohortState(spark, str(tmp_path), P)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # as many tasks as a large batch has
    try:
        for k in range(2):
            state.append(make_txn(spark, batch(rng, 600, months)))
            assert len(list(tmp_path.glob(f"pairs/{k:06d}/*/*.parquet"))) == len(months)
    finally:
        spark.conf.unset(key)


def test_rows_per_customer_and_transaction_are_not_broadcast(spark, tmp_path):
    """Neither by the size of files nor by what a stage turned out to have; only the batch's cells are."""
    rng = random.Random(7)
    state = CohortState(spark, str(tmp_path), P)
    key, plans = "spark.sql.autoBroadcastJoinThreshold", []
    before, write = spark.conf.get(key), state._write
    state._write = lambda df, kind, *by: (plans.append(df), write(df, kind, *by))
    spark.conf.set(key, "10m")
    try:
        for months in ([5, 6], [2, 6, 7]):
            state.append(make_txn(spark, batch(rng, 200, months)))
            for df in plans:
                df.collect()
                joins = re.findall(r"BroadcastHashJoin \[(.*)", df._jdf.queryExecution().executedPlan().toString())
                assert not [j for j in joins if not j.startswith("cohort#")], joins
            plans.clear()
    finally:
        spark.conf.set(key, before)


def test_the_query_maps_its_table_once(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    def counted(part):
        asked.add(1)
        return part

    def table(spark, sf, **how):
        rows = transactions_from_tables(spark, sf, **how).coalesce(1)
        return spark.createDataFrame(rows.rdd.mapPartitions(counted), rows.schema)

    want = rows_of(C.cohort_cells(transactions_from_tables(spark, SF), FIXTURE_PARAMS))
    monkeypatch.setattr(catalog, "txn", table)
    assert rows_of(catalog.q_cohort_cells_incremental(spark, SF)) == want
    assert asked.value == 1


def test_merged_parts_are_not_broadcast(spark):
    """Two relations of all parts came to the driver where their files are small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "10m")
    try:
        rows, merged = (transactions_from_tables(spark, SF, merge_parts=m) for m in (False, True))
        assert rows_of(merged) == rows_of(rows)
        plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
        assert re.search(r"BroadcastHashJoin \[l_partkey", plan(rows)) and not re.search(r"BroadcastHashJoin \[l_partkey", plan(merged))
    finally:
        spark.conf.set(key, before)
