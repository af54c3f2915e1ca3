"""S1/S2 at scale: the transaction table kept by customer.

First dates, purchases and profiles all meet a customer's rows, so a table
bucketed by customer lets them aggregate and join without an exchange. A bucket
is one task, though, and a customer with a hundredth of all rows (or the rows
without one) would make a bucket that is far larger than the others. Such rows
are kept apart, in a second, unbucketed table (both are written by one pass
over the rows); as no customer is in both, what
is computed per customer is the union of the two, where the rows apart go
through the split join (:mod:`vintage.operators.skew`)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.operators.clean import branch_b_rows, dated, first_transaction
from vintage.operators.ranking import input_bytes
from vintage.operators.skew import frequent
from vintage.params import Params

#: Bytes of input files that a bucket stands for.
BUCKET_BYTES = 32 << 20


@dataclass(frozen=True)
class CustomerStore:
    """Table ``name`` (bucketed by customer; its partition ``_apart`` = true
    has the rows without a customer or of a heavy one) and table ``name``_apart
    over that partition's files, without buckets."""
    spark: SparkSession
    name: str

    @property
    def bucketed(self) -> DataFrame:
        return self.spark.table(self.name).where("not _apart").drop("_apart")

    @property
    def apart(self) -> DataFrame:
        return self.spark.table(f"{self.name}_apart")

    def rows(self) -> DataFrame:
        """All rows."""
        return self.bucketed.unionByName(self.apart)

    def first_transactions(self) -> DataFrame:
        """A4; no exchange for the bucketed customers."""
        return first_transaction(self.bucketed).unionByName(first_transaction(self.apart))

    def branch_b(self, p: Params) -> DataFrame:
        """F5–F8, K2, X5 (see ``clean.branch_b``); no exchange for the
        bucketed customers."""
        near = branch_b_rows(dated(self.bucketed, p), first_transaction(self.bucketed), p, split=False)
        far = branch_b_rows(dated(self.apart, p), first_transaction(self.apart), p, split=True)
        return near.unionByName(far)


def buckets_for(txn: DataFrame, least: int = 16) -> int:
    """Buckets of about BUCKET_BYTES of the files that ``txn`` comes from, so
    that a task can sort one in memory, and at least ``least``."""
    return max(least, -(-input_bytes(txn) // BUCKET_BYTES))


def write_customer_store(txn: DataFrame, name: str, path: str, buckets: int, share: float = 0.01) -> CustomerStore:
    """Write ``txn`` to the tables of a :class:`CustomerStore` below ``path``
    (a folder that driver and executors share), in one pass over ``txn`` after
    the one that finds the heavy customers. One file a bucket; the rows apart
    are dealt out by transaction and amount."""
    spark, heavy = txn.sparkSession, F.broadcast(frequent(txn, "customer_id", share))  # a bounded list
    rows = txn.join(heavy, F.col("customer_id") == F.col("_heavy"), "left")
    rows = rows.withColumn("_apart", F.col("customer_id").isNull() | F.col("_heavy").isNotNull()).drop("_heavy")
    any_task = F.concat_ws("|", "transaction_id", "transaction_item_code", "transaction_amount")
    (rows.repartition(buckets, F.when(F.col("_apart"), any_task).otherwise(F.col("customer_id")))
     .write.mode("overwrite").format("parquet").option("path", f"{path}/rows").partitionBy("_apart")
     .bucketBy(buckets, "customer_id").sortBy("customer_id").saveAsTable(name))
    spark.catalog.createTable(f"{name}_apart", path=f"{path}/rows/_apart=true", source="parquet", schema=txn.schema)
    return CustomerStore(spark, name)
