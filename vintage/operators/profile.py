"""Data profiling.

Every statistic is one aggregate pass over the table (counts, sums and
distinct counts are partial aggregates), then reshaped to one row per column
with ``unpivot``. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.functions import rnd
from vintage.operators.quantiles import bucket_table, refined_quantiles
from vintage.operators.sketches import LG_K, cell_sketches, estimates
from vintage.session import materialize

CATEGORICAL = ("frequency_of_payment", "product_type", "country")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows in a deterministic order (all columns ascending,
    nulls first). Top-k per task, then a merge of k rows per task."""
    return df.orderBy(*[F.asc_nulls_first(c) for c in df.columns]).limit(n)


def _type_rows(df: DataFrame) -> list[tuple[int, str, str]]:
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]


def non_null_info(df: DataFrame) -> DataFrame:
    """P6 (``info()``): position, column, non-null count and type of every
    column, from one aggregate pass."""
    types = _type_rows(df)
    counts = df.agg(*[F.count(F.col(c)).alias(c) for _, c, _ in types])
    long = counts.unpivot([], [c for _, c, _ in types], "column", "non_null")
    meta = F.create_map(*[x for i, c, _ in types for x in (F.lit(c), F.lit(i))])
    tmap = F.create_map(*[x for _, c, t in types for x in (F.lit(c), F.lit(t))])
    return long.select(meta[F.col("column")].alias("position"), "column", "non_null",
                       tmap[F.col("column")].alias("type"))


def columns(df: DataFrame) -> DataFrame:
    """The column list (position, column), each with its filled rows."""
    return non_null_info(df).select("position", "column", "non_null")


def dtypes(df: DataFrame) -> DataFrame:
    """(column, type), each with its filled rows."""
    return non_null_info(df).select("column", "type", "non_null")


def columns_by_type(df: DataFrame) -> DataFrame:
    """P5: columns grouped by type, sorted names joined with ', ', and the
    filled values of all columns of the type."""
    return (dtypes(df).groupBy("type")
            .agg(F.concat_ws(", ", F.sort_array(F.collect_list("column"))).alias("columns"),
                 F.sum("non_null").cast("bigint").alias("non_null")))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column (rows - non-null)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in cols])
    long = agg.unpivot(["_rows"], cols, "column", "non_null")
    return long.select("column", (F.col("_rows") - F.col("non_null")).alias("n_null"))


def any_null(df: DataFrame) -> DataFrame:
    """Does the column hold a null?"""
    return null_counts(df).select("column", (F.col("n_null") > 0).alias("has_null"))


def n_unique(df: DataFrame, cols: tuple[str, ...] = CATEGORICAL) -> DataFrame:
    """Distinct non-null values per categorical column."""
    agg = df.agg(*[F.countDistinct(c).alias(c) for c in cols])
    return agg.unpivot([], list(cols), "column", "n_unique")


def n_unique_approx(df: DataFrame, cols: tuple[str, ...] = CATEGORICAL, lg_k: int = LG_K) -> DataFrame:
    """P9, approximate: the same from one sketch per column, all columns in one
    pass without a shuffle of values (see :mod:`vintage.operators.sketches`)."""
    return estimates(cell_sketches(df, [], cols, lg_k), cols).unpivot([], list(cols), "column", "n_unique")


def unique_values(df: DataFrame, cols: tuple[str, ...] = CATEGORICAL) -> DataFrame:
    """P10: every distinct value (null included) of each categorical column
    with its row count — one pass: each row is exploded once per column and
    pre-aggregated before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    return (df.select(pairs.alias("_p")).select("_p.column", "_p.value")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows")))


NUMERIC = ("transaction_amount", "quantity")


def describe(df: DataFrame, cols: tuple[str, ...] = NUMERIC) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (exact, linear) and max
    per numeric column, in two passes over the table: one for counts, sums and
    squares of all columns by bucket of the value, one for the values in the
    buckets that hold the quartiles (:func:`quantiles.refined_quantiles`).

    Sums are exact decimals and become double once, so mean and variance do
    not depend on the order rows arrive in. With m the mean to two decimals,
    the sums around it follow exactly: Σ(x-m) = Σx - nm and Σ(x-m)² = Σx² -
    2mΣx + nm², so var = (Σd² - (Σd)²/n) / (n - 1) of d = x - m, where nothing
    cancels; std is reported to 6 decimals.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("decimal(18,2)").alias("value")) for c in cols]))
    values = df.select(each.alias("_v")).select("_v.*")
    x = F.col("value")
    buckets = materialize(bucket_table(values, "value", ("column",), (
        F.sum(x).alias("_s"), F.sum((x * x).cast("decimal(38,4)")).alias("_ss"), F.min(x).alias("min"), F.max(x).alias("max"))))
    whole = lambda c: F.sum(c).cast("decimal(38,4)")
    stats = buckets.groupBy("column").agg(
        F.sum("_n").alias("count"), whole("_s").alias("_s"), whole("_ss").alias("_ss"),
        F.min("min").cast("double").alias("min"), F.max("max").cast("double").alias("max"))
    n = F.col("count")
    m = F.round(F.col("_s").cast("double") / n, 2).cast("decimal(18,2)")
    d = (F.col("_s") - m * n).cast("double")
    dd = ((F.col("_ss") - (2 * m * F.col("_s")).cast("decimal(38,4)")).cast("decimal(38,4)") + (m * m * n).cast("decimal(38,4)")).cast("double")
    var = (dd - (d * d) / n) / (n - F.lit(1))
    stats = stats.select("column", "count", (F.col("_s").cast("double") / n).alias("mean"),
                         F.when(n > 1, rnd(F.sqrt(F.greatest(var, F.lit(0.0))), 6)).alias("std"), "min", "max")
    q = refined_quantiles(values, buckets, "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], ("column",))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (every.join(stats, "column", "left").join(q, "column", "left")
            .select("column", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max"))
