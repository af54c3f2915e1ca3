"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.session import ensure_checkpoint_dir, ship

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's checkpoint folder, which driver
    and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads don't go back to the raw texts, also
    after the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: str | None) -> list[str]:
    """Lower-case words: runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 300_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return h


def positions(df: DataFrame, order: list[str], group: list[str] | None = None,
              size: str | None = None, parts: int | None = None) -> DataFrame:
    """Add ``_at``: the number of rows (or the sum of ``size``) before a row
    of its ``group``, in the order of ``order`` (nulls first).

    The rows are dealt out by range, sorted and checkpointed; a row's number
    inside its slice is known from there, so only the totals of the slices
    (slices x groups) go through a window. ``group`` must lead ``order``.
    Rows that agree in all of ``order`` may swap places."""
    group = group or []
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    rows = cut(dealt.sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_slice", F.shiftrightunsigned("_id", 33))
    total = F.sum(size) if size else F.count(F.lit(1))
    slices = rows.groupBy("_slice", *group).agg(total.alias("_n"), F.min("_id").alias("_first"))
    from pyspark.sql import Window as W
    before = W.partitionBy(*[F.col(c) for c in group]).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select("_slice", *group, "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    s = slices.select(F.col("_slice").alias("_s"), *[F.col(c).alias(f"_g_{c}") for c in group], "_first", "_base")
    cond = rows["_slice"] == s["_s"]
    for c in group:
        cond = cond & rows[c].eqNullSafe(s[f"_g_{c}"])
    if size:
        inside = W.partitionBy("_slice", *group).orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        cond = rows["_slice"] == s["_s"]
        for c in group:
            cond = cond & rows[c].eqNullSafe(s[f"_g_{c}"])
        at = F.col("_base") + F.col("_in")
    else:
        at = F.col("_base") + F.col("_id") - F.col("_first")
    return (rows.join(s, cond).withColumn("_at", at.cast("long"))
            .drop("_id", "_slice", "_s", "_first", "_base", "_in", *[f"_g_{c}" for c in group]))


def text_key(text: Column) -> Column:
    """Breaks ties between rows of one id; equal for equal texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the planner then
    knows its size, and joins broadcast it only below Spark's threshold."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where ``df`` has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_id(text: Column) -> Column:
    """16 bytes that name a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, written and counted, to be broadcast if it has at most so many rows."""
    df = staged(df, "keys")
    return F.broadcast(df) if df.count() <= rows else df


#: Edges that one task joins faster than many.
FEW = 100_000
#: Names with more than HEAVY edges and more than 2 / HEAVY_SHARE of all are
#: joined by broadcast: fewer than HEAVY_SHARE of them can exist.
HEAVY, HEAVY_SHARE = 256, 50_000


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` (a, b) with ``m`` of ``least`` (a, m, n). Rows of heavy names
    never meet in a task: their few minima are broadcast."""
    bound = max(HEAVY, 2 * n // HEAVY_SHARE)
    heavy = least.where(F.col("n") > bound).select(F.col("a").alias("_h"), F.col("m").alias("_hm"))
    rows = edges.join(F.broadcast(heavy), F.col("a") == F.col("_h"), "left").drop("_h")
    light = rows.where("_hm is null").drop("_hm").join(least.where(F.col("n") <= bound).select("a", "m"), "a")
    return light.select("a", "b", "m").unionByName(rows.where("_hm is not null").select("a", "b", F.col("_hm").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (a, root): the smallest name of each one's component,
    by alternating large and small stars (Kiveris et al. 2014). A name with
    many edges, such as the root of a large component, is not joined in one
    task (`_with_least`). Rounds are written to the shared folder; a checkpoint
    would carry on the constraints of all rounds before, whose number doubles
    with each. A round of no more than FEW edges needs no shuffles."""
    e, before = staged(edges.where("a != b").distinct(), "edges"), None
    n = e.count()
    while True:
        one = (lambda df: df.coalesce(1)) if n <= FEW else (lambda df: df)
        stars = lambda rows, least: one(_with_least(one(rows), one(least), 2 * n)).select(F.col("b").alias("a"), F.col("m").alias("b"))  # noqa: B023, E731
        both = one(e.union(e.select("b", "a")).toDF("a", "b"))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m")), "least")
        large = staged(stars(both.where("b > a"), least).distinct(), "large")
        least = staged(one(large).groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        linked = stars(large, least).where("a != b").union(one(least).select("a", F.col("m").alias("b")))
        e = staged(one(linked).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.toDF("a", "root")
        before, n = now, now[0]
