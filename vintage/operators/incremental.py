"""K13 kept up to date batch by batch (§2.11): the cell table after each batch
equals one run over all rows so far, late and early rows included.

State is a folder of Parquet tables; a batch adds a part to each of them and
never rewrites rows:

* ``a``: branch-A counts and revenue per cell. They add up.
* ``first``: earliest dates per customer that a batch brought; the least counts.
* ``pairs``: the distinct (customer, month, transaction) that are new,
  partitioned by month, so that a batch reads the months it has rows of.
* ``cells``: K8's two distinct counts per cell, whole (months² rows at most).

Distinct counts don't add up, and an earlier first date moves a customer's
cells to another cohort. So a batch finds the cells it touches (months with new
pairs, and for customers who moved, their months in the old and the new
cohort), counts these anew from the pairs of their months, and keeps the rest.
A batch that failed is appended again: its parts are overwritten.

The driver plans and lists, so that is kept bounded: a batch's rows are asked
for twice (states; transactions, which are staged), each part of ``pairs`` is listed
once a batch, its files grow with its bytes and months and not with tasks x
months, and a part with a row per customer or transaction is merged, never
broadcast: its files are many times smaller than its rows in memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintage.functions import month_diff, month_start, rnd
from vintage.operators import cells as C
from vintage.operators.clean import dated, first_transaction
from vintage.operators.levels import cell_states
from vintage.params import Params
from vintage.session import materialize, staged

SCHEMAS = {
    "a": "cohort date, txn_month date, no_of_customers long, revenue_dec decimal(38,2)",
    "first": "customer_id string, first_transaction_date date",
    "pairs": "customer_id string, transaction_id string, txn_month date",
    "cells": "cohort date, txn_month date, total_transactions long, total_customers long",
}


def columns(p: Params) -> list[str]:
    """What a state reads of a transaction."""
    return ["transaction_id", "customer_id", "transaction_date", "first_transaction_month", "transaction_amount", "quantity", *p.filters]


def transactions_of(rows: DataFrame) -> DataFrame:
    """The distinct (customer, month, transaction) of rows with a customer and
    a date, each with its earliest day, from one pass, written once."""
    return staged(rows.where(F.col("transaction_date").isNotNull() & F.col("customer_id").isNotNull())
                  .groupBy("customer_id", "transaction_id", month_start("transaction_date").alias("txn_month"))
                  .agg(F.min("transaction_date").alias("transaction_date")))


class CohortState:
    """State below ``path`` (a folder that driver and executors share) after
    ``batches`` batches. Without segments; rows, not distinct customers."""

    def __init__(self, spark: SparkSession, path: str, p: Params, batches: int = 0):
        if p.segment_cols or p.distinct_customers:
            raise ValueError("a state has no segments and counts rows")
        self.spark, self.path, self.p, self.batches = spark, path.rstrip("/"), p, batches

    def _part(self, kind: str, batch: int) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.path}/{kind}/{batch:06d}")

    def _all(self, kind: str, batches: int) -> DataFrame:
        if not batches:
            columns = T.StructType.fromDDL(SCHEMAS[kind])
            return self.spark.range(1).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in columns]).where(F.lit(False))
        return reduce(DataFrame.unionByName, [self._part(kind, k) for k in range(batches)])

    def _write(self, df: DataFrame, kind: str, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{kind}/{self.batches:06d}")

    def _first(self, batches: int) -> DataFrame:
        return (self._all("first", batches).groupBy("customer_id")
                .agg(F.min("first_transaction_date").alias("first_transaction_date")).hint("merge"))

    def append(self, rows: DataFrame) -> DataFrame:
        """Add a batch; returns the cells (cohort, txn_month) it touched."""
        k, p = self.batches, self.p
        states = cell_states(rows, p, [])
        self._write(states.select("cohort", "txn_month", "no_of_customers", F.col("revenue_dec").cast("decimal(38,2)").alias("revenue_dec")), "a")

        made = transactions_of(rows)
        old = self._first(k).withColumnRenamed("first_transaction_date", "_old")
        brought = first_transaction(made).join(old, "customer_id", "left")
        earlier = materialize(brought.where(F.col("_old").isNull() | (F.col("first_transaction_date") < F.col("_old"))))
        self._write(earlier.select("customer_id", "first_transaction_date"), "first")

        pairs, before = dated(made, p).select("customer_id", "transaction_id", "txn_month"), self._all("pairs", k)
        months = [r[0] for r in pairs.select("txn_month").distinct().collect()]  # a row a month
        seen = before.where(F.col("txn_month").isin(months)).select(*[F.col(c).alias(f"_{c}") for c in pairs.columns])
        same = [pairs[c].eqNullSafe(seen[f"_{c}"]) for c in pairs.columns]
        # by month: else every task would write a file of every month
        self._write(pairs.join(seen.hint("merge"), same, "left_anti").hint("rebalance", "txn_month"), "pairs", "txn_month")
        new = self._part("pairs", k)
        so_far = before.unionByName(new)

        first = self._first(k + 1).select("customer_id", month_start("first_transaction_date").alias("cohort"))
        moved = earlier.where(month_start("_old") != month_start("first_transaction_date")).select("customer_id", month_start("_old").alias("_from")).hint("merge")
        there = lambda df: df.select("customer_id", "txn_month").distinct()
        changed = there(new).withColumn("_from", F.lit(None).cast("date")).unionByName(there(so_far).join(moved, "customer_id"))
        touched = (changed.join(first, "customer_id").select("cohort", "_from", "txn_month").distinct()
                   .select(F.explode(F.array_compact(F.array("cohort", "_from"))).alias("cohort"), "txn_month"))
        touched = materialize(touched.distinct())  # months² rows at most
        months = [r[0] for r in touched.select("txn_month").distinct().collect()]
        fresh = (so_far.where(F.col("txn_month").isin(months)).join(first, "customer_id")
                 .join(touched, ["cohort", "txn_month"], "left_semi")
                 .groupBy("cohort", "txn_month")
                 .agg(F.countDistinct("transaction_id").alias("total_transactions"), F.countDistinct("customer_id").alias("total_customers")))
        kept = self._all("cells", 0) if k == 0 else self._part("cells", k - 1)
        self._write(kept.join(touched, ["cohort", "txn_month"], "left_anti").unionByName(fresh), "cells")
        self.batches += 1
        return touched

    def purchases(self) -> DataFrame:
        """K8 (see ``cells.purchases``)."""
        p, counts = self.p, self._part("cells", self.batches - 1) if self.batches else self._all("cells", 0)
        inside = (F.col("cohort") >= F.to_date(F.lit(p.min_cohort))) & (F.col("cohort") < F.to_date(F.lit(p.as_of)))
        return counts.where(inside).select(
            "cohort", "txn_month", month_diff("txn_month", "cohort").alias("period_number"), "total_transactions", "total_customers",
            rnd(F.col("total_transactions") / F.col("total_customers"), 1).alias("no_of_cust_purchases"))

    def cells(self) -> DataFrame:
        """K13 over all batches."""
        p = self.p
        c = (self._all("a", self.batches).groupBy("cohort", "txn_month")
             .agg(F.sum("no_of_customers").alias("no_of_customers"), F.sum("revenue_dec").cast("decimal(28,2)").alias("revenue_dec"))
             .withColumn("period_number", month_diff("txn_month", "cohort")))
        c = C.with_arpu(C.with_revenue(C.with_active_lost(C.with_retention(c, p), p), p))
        c = C.with_purchases(c, self.purchases(), p)
        c = C.with_ltv(C.with_margin(C.with_ltv_inputs(c, p), p), p)
        return c.select(*C.CELL_COLUMNS)
