"""Distributed running counts within groups that may be huge.

``Window.partitionBy(group).orderBy(...)`` puts a whole group in one task; a
cell, or one customer, can hold a third of all rows. Here the rows are range
partitioned on (group, order) keys instead, so a hot group is cut into
contiguous slices over many tasks:

1. ``repartitionByRange(n, group + order)``, sort each slice and number its
   rows (``monotonically_increasing_id``: slice and position in one number);
   the slices are written once, as Parquet, so every later read sees the same
   slices, even after an executor is lost; sorted columns take little room.
2. A row's position inside its (slice, group) piece is its number less the
   piece's first number. Only a weighted sum needs a window over the piece.
3. Per-(slice, group) totals (at most slices + groups rows) give each piece's
   offset by a running sum over the slices of its group.
4. Join the offsets back on (slice, group).

Slices hold about SLICE_BYTES of the files that the rows come from; there are
at least as many as shuffle partitions. The totals are written too: their size
is known then, and a few of them are broadcast, so that the rows stay where
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.session import staged


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond, "inner").drop(*[f"_r_{k}" for k in keys])


#: Bytes of input files a slice stands for when ``slices`` isn't given.
SLICE_BYTES = 64 << 20


def _default_slices(df: DataFrame, size: int | None = None) -> int:
    """As many slices as the size of the input files asks for (one for each
    ``size`` bytes, by default SLICE_BYTES), and at least one per shuffle
    partition."""
    spark = df.sparkSession
    try:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        least = spark.sparkContext.defaultParallelism
    return max(least, -(-input_bytes(df) // (size or SLICE_BYTES)))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as far as they are known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # what has no size counts as endless


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list[Column | str],
                weight: str | None = None, out: str = "_cum",
                slices: int | None = None, total_out: str | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``weight`` (1 per row when None)
    over ``order_cols`` within ``group_cols`` (and ``total_out`` = the group's
    total, when named). With unique order keys inside a group and no weight
    this is ``row_number()``."""
    n = slices or _default_slices(df)
    group_cols = list(group_cols)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [*[F.col(g) for g in group_cols], *order]
    sliced = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_id", F.monotonically_increasing_id())
              .withColumn("_slice", F.shiftrightunsigned("_id", 33)))
    sliced = staged(sliced)
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    totals = staged(sliced.groupBy("_slice", *group_cols).agg(F.sum(w).alias("_tot"), F.min("_id").alias("_first")))
    before = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    extra = [F.sum("_tot").over(Window.partitionBy(*group_cols)).alias(total_out)] if total_out else []
    offsets = totals.select("_slice", *group_cols, "_first",
                            F.coalesce(F.sum("_tot").over(before), F.lit(0).cast("bigint")).alias("_off"),
                            *extra)
    if weight:
        piece = Window.partitionBy("_slice", *group_cols).orderBy("_id")
        sliced = sliced.withColumn("_local", F.sum(w).over(piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        local = F.col("_local")
    else:
        local = F.col("_id") - F.col("_first") + 1
    joined = _join_null_safe(sliced, offsets, ["_slice", *group_cols])
    return (joined.withColumn(out, local + F.col("_off"))
            .drop("_id", "_slice", "_first", "_local", "_off"))


def row_number_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                      out: str = "RN", slices: int | None = None) -> DataFrame:
    """``row_number()`` over (group ordered by order_cols) for order keys that
    are unique within the group."""
    return running_sum(df, group_cols, order_cols, None, out, slices)
