"""Approximate distinct counts that merge (P9's approximate option).

A distinct count can't be added up: the customers of two months are fewer than
the sum. A HyperLogLog sketch per cell can be merged over any cells later,
without the rows: ``cell_sketches`` reads the table once, `merged` rolls the
sketches up to any subset of their keys, and ``estimates`` reads them. A
sketch has a few kilobytes whatever it has counted; with 2^k registers the
relative standard error is about 1.04 / sqrt(2^k), and counts up to some
hundreds are exact. Null values aren't counted, as in the exact counts; null
keys are groups of their own."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a sketch.
LG_K = 12


def error(lg_k: int = LG_K) -> float:
    """Relative standard error of a merged sketch."""
    return 1.04 / sqrt(2 ** lg_k)


def cell_sketches(df: DataFrame, keys: list[str], cols: tuple[str, ...], lg_k: int = LG_K) -> DataFrame:
    """One row per cell of ``keys`` with a sketch of each column (built map
    side, so a hot cell sends a sketch per task, not its rows)."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(c) for c in cols])


def merged(sketches: DataFrame, keys: list[str], cols: tuple[str, ...]) -> DataFrame:
    """Sketches of coarser groups: ``keys`` is a subset of the cells' keys."""
    return sketches.groupBy(*keys).agg(*[F.hll_union_agg(c).alias(c) for c in cols])


def estimates(sketches: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """The sketches' counts in their place."""
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in cols})
