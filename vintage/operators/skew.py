"""Joins whose keys may be hot, split by rule and not left to the run-time
planner.

`frequent` finds heavy keys with a sketch of frequent items: one pass with a
bounded state per task, no shuffle of keys. `split_join` spreads rows of heavy
and of null keys over ``parts`` salts. The other side repeats its rows of heavy
keys once per salt (a bounded list of keys, broadcast); null keys match nothing
and are only spread. All in one plan: nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch tracks and those it may report.
TRACKED, REPORTED = 10_000, 100


def frequent(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys with at least ``share`` of all rows (one column ``_heavy``). A key
    with more than 1 / TRACKED of the rows is never missed; at most REPORTED
    are returned, so ``share`` must be at least 1 / REPORTED."""
    if share * REPORTED < 1:
        raise ValueError("more keys could be that frequent than the sketch reports")
    found = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {REPORTED}, {TRACKED})").alias("_top"), F.count(F.lit(1)).alias("_n"))
    return (found.select(F.explode("_top").alias("_t"), "_n").where(F.col("_t.count") >= F.col("_n") * share)
            .select(F.col("_t.item").alias("_heavy")))


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy: DataFrame | None = None,
               share: float = 0.01, parts: int = 64) -> DataFrame:
    """``left`` joined to ``right`` on ``key`` (inner or left). ``heavy``: the
    keys to split, by default those `frequent` in ``left``."""
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    heavy = frequent(left, key, share) if heavy is None else heavy
    rows = salted(left, key, heavy, left.columns, parts)
    if how == "inner":
        rows = rows.where(F.col(key).isNotNull())
    return rows.join(each_salt(right, key, heavy, parts), [key, "_salt"], how).drop("_salt")


def salted(left: DataFrame, key: str, heavy: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """``left`` with ``_salt``: a number made of the columns ``by`` in rows of
    heavy and of null keys, 0 in the others."""
    heavy = F.broadcast(heavy)  # at most REPORTED keys
    spread = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    rows = left.join(heavy, F.col(key) == F.col("_heavy"), "left")
    return rows.withColumn("_salt", F.when(F.col("_heavy").isNotNull() | F.col(key).isNull(), spread).otherwise(0)).drop("_heavy")


def each_salt(right: DataFrame, key: str, heavy: DataFrame, parts: int = 64) -> DataFrame:
    """The other side of :func:`salted`: rows of heavy keys once per salt."""
    salts = F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    other = right.where(F.col(key).isNotNull()).join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    return other.withColumn("_salt", F.explode(salts)).drop("_heavy")
