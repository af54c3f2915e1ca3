"""Exact quantiles with numpy's linear interpolation, distributed.

The column is first reduced to a value histogram (partial aggregate), the
histogram gets running counts (``ranking.running_sum``, no single-task
sort) and group totals, and each requested position is picked by a
conditional aggregate over the running counts. No join without keys, nothing
collected.

Interpolation follows numpy's ``linear`` method (as pandas calls it, with
q = (p * 100) / 100) to the last bit:
h = (n - 1) * q, a = x[floor(h)], b = x[floor(h) + 1] (both the last value
when h >= n - 1), t = h - floor(h);
a + (b - a) * t when t < 0.5, else b - (b - a) * (1 - t).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.operators.ranking import running_sum


def lerp(a: Column, b: Column, t: Column) -> Column:
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def _positions(n: Column, p: float) -> tuple[Column, Column, Column]:
    q = (float(p) * 100.0) / 100.0
    h = (n - F.lit(1)) * F.lit(q)
    top = h >= (n - F.lit(1))
    lo = F.when(top, n - F.lit(1)).otherwise(F.floor(h).cast("bigint"))
    hi = F.when(top, n - F.lit(1)).otherwise(lo + F.lit(1))
    return lo, hi, h - F.floor(h)


def _inside(k: Column) -> Column:
    return (F.col("_cum") - F.col("_n") <= k) & (k < F.col("_cum"))


def exact_quantiles(df: DataFrame, col: str, probs: list[float],
                    names: list[str] | None = None,
                    group_cols: tuple[str, ...] = (),
                    bounded_values: bool = False) -> DataFrame:
    """Exact quantiles of ``col`` (nulls skipped): one row per group (one
    row overall without groups); NULL when a group has no value.

    ``bounded_values=True`` declares that a group has few distinct values
    whatever the data size (e.g. a customer's LTV is one of the cell LTVs):
    the histogram's running count is then a plain window over the histogram
    rows of a group. Otherwise it is the range-sliced running sum, which
    holds for any number of distinct values."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    g = list(group_cols)
    hist = (df.where(F.col(col).isNotNull()).groupBy(*g, col)
            .agg(F.count(F.lit(1)).alias("_n")))
    if bounded_values:
        part = Window.partitionBy(*g)
        cum = (hist.withColumn("_cum", F.sum("_n").over(
                   part.orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
               .withColumn("_total", F.sum("_n").over(part)))
    else:
        cum = running_sum(hist, g, [col], weight="_n", out="_cum", total_out="_total")
    v = F.col(col).cast("double")
    aggs = []
    for i, p in enumerate(probs):
        lo, hi, t = _positions(F.col("_total"), p)
        aggs += [F.max(F.when(_inside(lo), v)).alias(f"_a{i}"),
                 F.max(F.when(_inside(hi), v)).alias(f"_b{i}"),
                 F.max(t).alias(f"_t{i}")]
    # a global aggregate returns its one row (all NULL) even without values
    picked = cum.groupBy(*g).agg(*aggs)
    return picked.select(*g, *[lerp(F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_t{i}")).alias(nm)
                               for i, nm in enumerate(names)])


# ---------------------------------------------------------------- bucket refinement
#: Buckets of a value range that doubles; a bucket is 0.27 % wide.
BUCKETS_A_DOUBLING = 256


def value_bucket(v: Column) -> Column:
    """A bucket of a number that never falls when the number rises (NaN last)."""
    size = F.least(F.log2(F.abs(v) + F.lit(1.0)) * F.lit(float(BUCKETS_A_DOUBLING)), F.lit(1e9))
    return F.when(F.isnan(v), F.lit(2_000_000_000)).otherwise(F.signum(v) * F.floor(size)).cast("bigint")


def bucket_table(df: DataFrame, col: str, group_cols: tuple[str, ...] = (), extra: tuple[Column, ...] = ()) -> DataFrame:
    """First pass: rows (and ``extra`` aggregates) by group and bucket of
    ``col``, nulls left out. Some thousand rows a group, whatever the table."""
    v = F.col(col).cast("double")
    return (df.where(F.col(col).isNotNull()).groupBy(*group_cols, value_bucket(v).alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_n"), *extra))


def refined_quantiles(df: DataFrame, buckets: DataFrame, col: str, probs: list[float], names: list[str],
                      group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles of columns of any cardinality, one row per group that
    has a value. ``buckets`` (see :func:`bucket_table`) tell which buckets hold
    the wanted ranks; the second pass counts the distinct values of these only.
    No sort of the column, no range exchange: windows run over buckets, and
    over the values inside one."""
    g = list(group_cols)
    part = Window.partitionBy(*g)
    cum = (buckets.withColumn("_cum", F.sum("_n").over(part.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
           .withColumn("_total", F.sum("_n").over(part)))
    ranks = []
    for i, p in enumerate(probs):
        lo, hi, t = _positions(F.col("_total"), p)
        ranks += [F.struct(F.lit(2 * i).alias("which"), lo.alias("rank"), t.alias("t")),
                  F.struct(F.lit(2 * i + 1).alias("which"), hi.alias("rank"), t.alias("t"))]
    wanted = (cum.select(*g, "_bucket", "_n", "_cum", F.explode(F.array(*ranks)).alias("_r"))
              .where(_inside(F.col("_r.rank")))
              .select(*g, "_bucket", F.col("_r.which").alias("_which"), F.col("_r.t").alias("_t"),
                      (F.col("_r.rank") - (F.col("_cum") - F.col("_n"))).alias("_rank")))
    key = [*g, "_bucket"]
    v = F.col(col).cast("double")
    inside = (df.where(F.col(col).isNotNull()).select(*g, value_bucket(v).alias("_bucket"), v.alias("_v"))
              .join(wanted.select(*key).distinct(), key, "left_semi")
              .groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_n")))
    own = Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("_cum", F.sum("_n").over(own)).join(wanted, key).where(_inside(F.col("_rank")))
    pick = lambda k: F.max(F.when(F.col("_which") == k, F.col("_v")))
    t = lambda k: F.max(F.when(F.col("_which") == k, F.col("_t")))
    return found.groupBy(*g).agg(*[lerp(pick(2 * i), pick(2 * i + 1), t(2 * i)).alias(nm) for i, nm in enumerate(names)])
