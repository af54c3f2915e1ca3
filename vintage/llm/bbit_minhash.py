"""MinHash near-dedup (operator 12) with b-bit signatures.

Words are runs of anything but ASCII white space, A-Z in lower case; a
document's set are its distinct 4-word shingles (the whole sequence, if it has
fewer words), kept as 64-bit hashes. Documents of one set are one class and
are joined once. A class has 128 minima. 32 bands of four of them, still whole,
give the buckets in which classes meet (a pair of similarity 0.8 meets in none
with a chance of 5e-8). From there on only the lowest two bits of each minimum
go along, packed into 32 bytes: of two unequal minima a quarter agree in them
by chance, so from the share p of agreeing values, found by counting bits,
(p - 1/4) / (3/4) estimates the similarity (Li and Koenig 2010). Pairs that a
similarity of 0.8 would put so low with a chance under MISS are dropped; the
rest is confirmed on the whole sets, in whole numbers.

Components are all that is asked for, so a pair already connected isn't
confirmed again. First the members of a bucket are compared in portions of
PORTION. Buckets of more members then compare across portions, but only what
is in different components by now: members of a bucket's largest component
meet the others, not each other. A large group of near copies so costs little
more than its size.

A class is named by its smallest doc_id and a hash, so that the smallest name
of a component holds the component's id. Texts that are null, empty or
without words have an empty set and no links: their component is their own
doc_id. Rows without doc_id take part; a component of such rows only has a
null id. Repeated rows are in one class and share ``kept``. An empty table
gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import components, cut, small, text_id
from vintage.llm.ngram_join import candidate_pairs, groups, shared

SHINGLE = 4
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
#: Low bits kept of a minimum.
BITS = 2
MISS = 1e-8
PORTION = 512
#: Buckets and names of candidate texts (16 bytes each) that may be broadcast
#: to pick members and texts; more are joined by a shuffle.
BUCKETS, WANTED = 2_000_000, 1_000_000
REMEMBERED = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(12)
_FACTORS = _RNG.integers(1, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_LANES = np.uint64(0x5555555555555555)


class Hashes(dict):
    """word -> 64-bit hash, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, 12)
        return h


def shingle_set(text: str | None, hashes: Hashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``n`` words."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[:len(h) - n + 1] + np.uint64(n)
        for j in range(1, n):
            out = (out ^ (out >> np.uint64(31))) * _MIX + h[j:len(h) - n + 1 + j]
        out = (out ^ (out >> np.uint64(29))) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(grams: np.ndarray) -> np.ndarray:
    low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 2048):
            x = low[i:i + 2048, None] * _FACTORS + _TERMS
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            best = np.minimum(best, x.min(0))
        best ^= best >> np.uint32(13)
        best *= np.uint32(0xC2B2AE35)
    return best ^ (best >> np.uint32(16))


def packed(best: np.ndarray) -> bytes:
    """The low BITS of each minimum."""
    bits = (best[:, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8)).tobytes()


def bands(best: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band; its low five bits name the band."""
    halves = np.ascontiguousarray(best, "<u4").view("<u8").reshape(BANDS, 2)
    with np.errstate(over="ignore"):
        x = halves[:, 0] * _MIX
        x = ((x ^ (x >> np.uint64(29))) + halves[:, 1]) * _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX
    return ((x & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def tags(buckets: np.ndarray) -> bytes:
    """32 bits of each band, by which a pair finds its first common one."""
    return (buckets.view(np.uint64) >> np.uint64(32)).astype("<u4").tobytes()


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal values of packed signatures (rows of 64-bit words)."""
    x = left ^ right
    return VALUES - np.bitwise_count((x | (x >> np.uint64(1))) & _LANES).sum(1).astype(np.int64)


def estimate(equal: np.ndarray | int) -> np.ndarray | float:
    """Similarity corrected for values that agree by chance."""
    chance = 0.5 ** BITS
    return (equal / VALUES - chance) / (1 - chance)


def least_agreeing(threshold: float = 0.8, miss: float = MISS) -> int:
    """Smallest count that a pair of similarity ``threshold`` stays under with
    a chance of at most ``miss``."""
    p, total, m = threshold + (1 - threshold) * 0.5 ** BITS, 0.0, 0
    while True:
        total += comb(VALUES, m) * p ** m * (1 - p) ** (VALUES - m)
        if total > miss:
            return m
        m += 1


# --- tasks ------------------------------------------------------------------

def candidates(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that agree in their bucket's band first, could have the
    similarity by size and bits, and aren't connected; most alike first."""
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u8").reshape(len(t), -1)
    tag = np.frombuffer(b"".join(t.column("tags").to_pylist()), "<u4").reshape(len(t), -1)
    band = (t.column("bucket").to_numpy() & 31).astype(np.int64)
    size = t.column("n").to_numpy()
    _, root = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)
    out = [(np.zeros(0, np.int64),) * 3]
    for a, c in candidate_pairs(t):
        equal = agreeing(sig[a], sig[c])
        own = (equal >= least) & (root[a] != root[c]) & (5 * np.minimum(size[a], size[c]) >= 4 * np.maximum(size[a], size[c]))
        a, c, equal = a[own], c[own], equal[own]
        own = (tag[a] == tag[c]).argmax(1) == band[a]
        out.append((a[own], c[own], equal[own]))
    a, c, equal = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(-equal, kind="stable")
    return a[order], c[order], equal[order]


def _members(least: int) -> Callable:
    """Tasks -> the rows that take part in a candidate pair."""
    def run(batches):
        for t in groups(batches):
            a, c, _ = candidates(t, least)
            rows = np.unique(np.concatenate([a, c]))
            if len(rows):
                yield from t.take(pa.array(rows)).combine_chunks().to_batches()
    return run


def forest(sets: list[np.ndarray], a: np.ndarray, c: np.ndarray) -> list[int]:
    """Components of the sets under 100 * intersection >= 80 * union, from
    candidate pairs; a pair that is connected by then isn't looked at."""
    up, sizes = list(range(len(sets))), np.array([len(s) for s in sets], np.int64)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    while len(a):
        roots = np.array([top(x) for x in range(len(up))])
        apart = roots[a] != roots[c]
        a, c = a[apart], c[apart]
        now = max(32, len(sets))
        both = shared(sets, a[:now], c[:now])
        linked = 100 * both >= 80 * (sizes[a[:now]] + sizes[c[:now]] - both)
        for x, y in zip(a[:now][linked].tolist(), c[:now][linked].tolist(), strict=True):
            up[top(x)] = top(y)
        a, c = a[now:], c[now:]
    return [top(x) for x in range(len(up))]


def _links(least: int) -> Callable:
    """Tasks with texts -> (name of a class, a name that it is linked with)."""
    def run(batches):
        hashes = Hashes()
        for many in groups(batches):
            b, i, j = (many.column(k).to_numpy() for k in range(3))
            ends = np.concatenate([np.flatnonzero((b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(b)]])
            out, low = [], 0
            for high in ends.tolist():
                t, low = many.slice(low, high - low), high
                a, c, _ = candidates(t, least)
                roots = forest([shingle_set(x.as_py(), hashes) for x in t.column("text")], a, c)
                names, best = t.column("name").to_pylist(), {}
                for k, r in enumerate(roots):
                    best[r] = min(best.get(r, names[k]), names[k])
                out += [(names[k], best[r]) for k, r in enumerate(roots) if names[k] != best[r]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])
    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for text in batch.column("text"):
            grams = shingle_set(text.as_py(), hashes)
            row = (0, None, None, None, None)
            if len(grams):
                best = minima(grams)
                where = bands(best)
                row = (len(grams), hashlib.md5(grams.tobytes()).digest(), where, tags(where), packed(best))
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                         ["doc_id", "tid", "n", "key", "bands", "tags", "sig"])


# --- Spark ------------------------------------------------------------------

def name_of(doc_id: Column, key: Column) -> Column:
    """25 bytes that sort by doc_id, nulls last."""
    flipped = F.lpad(F.hex(doc_id.bitwiseXOR(F.expr("shiftleft(1L, 63)"))), 16, "0")
    return F.concat(F.unhex(F.when(doc_id.isNull(), "01").otherwise("00")), F.unhex(F.coalesce(flipped, F.lit("0" * 16))), key)


def id_in(name: Column) -> Column:
    """The doc_id in a name."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number.cast("long"))


def _confirmed(tasks: DataFrame, bodies: DataFrame, least: int) -> DataFrame:
    """Links (a, b) of the pairs within the tasks."""
    order = ["bucket", "i", "j"]
    own = [*order, "h", "name", "root", "tid", "n", "tags", "sig"]
    schema = "bucket long, i int, j int, h int, name binary, root binary, tid binary, n long, tags binary, sig binary"
    alive = cut(tasks.select(*own).repartition(*order).sortWithinPartitions(*order).mapInArrow(_members(least), schema))
    wanted = small(alive.select("tid").distinct(), WANTED)
    texts = bodies.join(wanted, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    full = alive.join(texts, "tid").select(*own, "text")
    return cut(full.repartition(*order).sortWithinPartitions(*order).mapInArrow(_links(least), "a binary, b binary"))


def _across(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Tasks of buckets of several portions: every member outside the
    bucket's largest component against all members."""
    big = met.join(roots.select(F.col("a").alias("name"), F.col("root").alias("_r")), "name", "left")
    big = cut(big.withColumn("root", F.coalesce("_r", "name")).drop("_r"))
    sizes = big.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all"))
    most = (most.where(F.col("all") > F.col("most.c"))
            .select("bucket", F.col("most.root").alias("main"), F.ceil((F.col("all") - F.col("most.c")) / PORTION).cast("int").alias("r")))
    big = big.join(most, "bucket")
    rest = big.where("root != main").withColumn("h", -1 - F.pmod(F.xxhash64("name", F.lit(5)), F.col("r")).cast("int"))
    rest = rest.withColumn("i", F.col("h")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    all_ = big.withColumn("j", F.col("h")).withColumn("i", F.explode(F.sequence(-F.col("r"), F.lit(-1))))
    return rest.drop("main", "r").unionByName(all_.drop("main", "r"))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) -> rows (doc_id, n, key) and classes (key,
    name, root: the smallest name of the component)."""
    least = least_agreeing()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_id(F.col("text")).alias("tid"))
    rows = cut(named.mapInArrow(_signed, "doc_id long, tid binary, n long, key binary, bands array<long>, tags binary, sig binary"))
    first = [F.first(c).alias(c) for c in ("n", "bands", "tags", "sig")]
    texts = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("tid").alias("tid"), *first)
    texts = cut(texts.withColumn("name", name_of(F.col("doc_id"), F.col("key"))).drop("doc_id"))
    placed = texts.select("name", F.explode("bands").alias("bucket"))
    full = small(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), BUCKETS)

    def met(buckets: DataFrame) -> DataFrame:
        """Members of the buckets, dealt out in ``m`` portions ``h``."""
        rows = placed.join(buckets, "bucket").withColumn("m", F.ceil(F.col("_n") / PORTION).cast("int")).drop("_n")
        rows = rows.withColumn("h", F.pmod(F.xxhash64("name", "bucket"), F.col("m")).cast("int"))
        return rows.join(texts.select("name", "tid", "n", "tags", "sig"), "name")

    bodies = named.select("tid", "text")
    links = _confirmed(met(full).withColumn("root", F.col("name")).withColumn("i", F.col("h")).withColumn("j", F.col("h")), bodies, least)
    roots = components(links)
    large = full.where(F.col("_n") > PORTION)
    if large.limit(1).count():  # else every bucket has been compared as a whole
        more = _confirmed(_across(met(large), roots), bodies, least)
        roots = components(roots.toDF("a", "b").union(more))
    out = texts.select("key", "name").join(roots.withColumnRenamed("a", "name"), "name", "left")
    return rows.select("doc_id", "n", "key"), out.withColumn("root", F.coalesce("root", "name"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links), kept (it is that document)."""
    rows, classes = near_classes(docs)
    ids = classes.select("key", id_in(F.col("root")).alias("_component"), F.lit(True).alias("_found"))
    out = rows.join(ids, "key", "left").withColumn("component_id", F.when(F.col("_found"), F.col("_component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
