"""Hot and null keys: split joins, purchases of shared transactions, sketches."""

import contextlib
import io
import random

import pytest
from conftest import GOLDEN_PARAMS as P
from conftest import F_, M, SF, UK, make_txn
from pyspark.sql import functions as F

from vintage.operators import cells as C
from vintage.operators import sketches as SK
from vintage.operators import skew
from vintage.plans.catalog import REGISTRY


def plan_of(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows null, a third one customer."""
    return spark.range(90_000).select(
        F.when(F.col("id") % 3 == 1, "hot").when(F.col("id") % 3 == 2, F.concat(F.lit("c"), F.col("id") % 5000)).alias("customer_id"), "id")


def test_frequent_keys(hot):
    assert [r._heavy for r in skew.frequent(hot, "customer_id", 0.05).collect()] == ["hot"]
    with pytest.raises(ValueError):
        skew.frequent(hot, "customer_id", 0.001)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_join_and_is_even(spark, hot, how):
    right = hot.where("customer_id is not null and customer_id != 'c2'").groupBy("customer_id").agg(F.min("id").alias("first"))
    right = right.union(spark.createDataFrame([(None, 7), ("nobody", 8)], "customer_id string, first long"))
    got = skew.split_join(hot, right, "customer_id", how)
    assert got.columns == ["customer_id", "id", "first"]
    want = hot.join(right, "customer_id", how)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        even = skew.split_join(hot, right, "customer_id", how)
        assert "SortMergeJoin" in plan_of(even)
        sizes = sorted(r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_split_join_of_nothing(spark, hot):
    right = spark.createDataFrame([], "customer_id string, first long")
    assert skew.split_join(hot, right, "customer_id").count() == 0
    assert skew.split_join(hot.limit(0), right, "customer_id", "left").count() == 0
    assert skew.split_join(hot.limit(9), right, "customer_id", "left").count() == 9


def test_purchases_has_no_expand(spark):
    assert "Expand" not in plan_of(REGISTRY["purchases"][0](spark, SF))


def test_purchases_of_transactions_with_several_customers(spark):
    random.seed(5)
    rows = [(f"t{random.randrange(60)}" if i % 11 else None, f"c{random.randrange(12)}", f"2010-{1 + random.randrange(4):02d}-0{1 + i % 8}",
             "2010-01-01", 10, M, F_, UK, 1, "i1") for i in range(500)]
    txn = make_txn(spark, rows)
    got = {(r.cohort, r.txn_month): (r.total_transactions, r.total_customers) for r in C.purchases(txn, P).collect()}
    first = {}
    for r in rows:
        first[r[1]] = min(first.get(r[1], "9"), r[2])
    want = {}
    for t, c, d, *_ in rows:
        cell = want.setdefault((first[c][:7], d[:7]), (set(), set()))
        cell[0].add(t)
        cell[1].add(c)
    assert {(str(a)[:7], str(b)[:7]): v for (a, b), v in got.items()} == {k: (len(t - {None}), len(c)) for k, (t, c) in want.items()}
    assert any(len(t - {None}) < sum(len({x for x, y, z, *_ in rows if y == c and z[:7] == k[1]} - {None}) for c in cs)
               for k, (t, cs) in want.items())  # shared transactions occur


def test_sketches_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 9_000).alias("v"))
    cells = SK.cell_sketches(df, ["a", "b"], ("v",))
    for keys in (["a"], ["b"], []):
        est = {tuple(r)[:-1]: r.v for r in SK.estimates(SK.merged(cells, keys, ("v",)), ("v",)).collect()}
        exact = {tuple(r)[:-1]: r.v for r in df.groupBy(*keys).agg(F.countDistinct("v").alias("v")).collect()}
        assert est.keys() == exact.keys() and all(abs(est[k] - exact[k]) <= 4 * SK.error() * exact[k] for k in exact)
    empty = SK.estimates(SK.merged(SK.cell_sketches(df.limit(0), ["a"], ("v",)), [], ("v",)), ("v",)).collect()
    assert [r.v for r in empty] in ([None], [0])
    few = SK.estimates(SK.cell_sketches(df.where("id < 0").union(df.limit(30)), [], ("v",)), ("v",)).first()
    assert few.v == 30
