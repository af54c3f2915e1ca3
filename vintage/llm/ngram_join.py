"""N-gram Jaccard join (operator 8) with Bayesian candidate pruning.

Texts are sets of five-word shingles (lower-case words; a text of fewer words
is one shingle of them all). Equal texts form one class and are joined once.
Each distinct text has 104 MinHash values of 16 bits; texts that agree in one
of 26 bands of four values meet in a bucket, which misses a pair of similarity
0.8 with a chance of 1e-6. Inside a bucket the MinHash values of a pair are
compared a few at a time, and the pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below TOLERANCE
(Satuluri and Parthasarathy 2012). What is left is verified on the whole
shingle sets.

A pair belongs to the first band in which it agrees, so no pair is counted
twice and no list of pairs is made: tasks get the members of a bucket, in
blocks of at most BLOCK against BLOCK, and return for each text the number of
its links there and the smallest text that they lead to. The classes are the
components of these.

Null and empty texts, and texts without any word, are linked to their copies
only. Rows with a null doc_id take part and are named by the smallest doc_id
of their class (null if there is none). An empty table gives an empty
result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import WordHashes, components, cut, free, text_id, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 4
VALUES = BANDS * ROWS
TOLERANCE = 1e-8
STEPS = (16, 32, 48, 64, 80, VALUES)
BLOCK = 512
#: Pairs whose MinHash values are compared at a time.
PAIRS = 40_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(8)
_FACTORS = _RNG.integers(1, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingles(text: str | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    own = words(text)
    h = np.array([hashes[w] for w in own], np.uint64)
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[:len(h) - n + 1].copy()
        for j in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[j:len(h) - n + 1 + j]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(grams: np.ndarray) -> bytes:
    """MinHash values, 16 bits of each."""
    low = (grams ^ (grams >> np.uint64(31))).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 2048):
            x = low[i:i + 2048, None] * _FACTORS + _TERMS
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            best = np.minimum(best, x.min(0))
    return (best ^ (best >> np.uint32(16))).astype("<u2").tobytes()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Fewest equal values, for each of STEPS, with which a pair goes on: under
    a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in STEPS:
        p, m = (1 - threshold) ** (n + 1), 0
        while p < tolerance:
            m += 1
            p += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (rows of ``sigs``) belong to ``band`` and outlive the pruning."""
    alive = np.arange(len(left))
    same = (sigs[left].view("<u8") == sigs[right].view("<u8"))  # whole bands
    alive = alive[same.argmax(1) == band]
    alive = alive[same[alive, band[alive]]]
    matches, low = np.zeros(len(left), np.int64), 0
    for high, m in zip(STEPS, least, strict=True):
        matches[alive] += (sigs[left[alive], low:high] == sigs[right[alive], low:high]).sum(1)
        alive, low = alive[matches[alive] >= m], high
    return alive


# --- groups in sorted batches -----------------------------------------------

def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole tasks (columns bucket, i, j lead) of a sorted partition."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        keys = [held.column(k).to_numpy() for k in range(3)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(new):
            yield held.slice(0, int(new[-1])).combine_chunks()
            held = held.slice(int(new[-1]))
    if held is not None and len(held):
        yield held.combine_chunks()


def candidate_pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within each task, some PAIRS at a time; in a task of two
    blocks, those across them."""
    b, i, j, h = (t.column(k).to_numpy() for k in range(4))
    starts = np.concatenate([[0], np.flatnonzero((b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(b)]])
    left, right, n = [], [], 0
    half: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if i[low] == j[low]:
            if high - low not in half:
                half[high - low] = np.triu_indices(high - low, 1)
            a, c = half[high - low]
            a, c = a + low, c + low
        else:
            one, two = low + np.flatnonzero(h[low:high] == i[low]), low + np.flatnonzero(h[low:high] == j[low])
            a, c = np.repeat(one, len(two)), np.tile(two, len(one))
        left.append(a)
        right.append(c)
        n += len(a)
        if n >= PAIRS:
            a, c = np.concatenate(left), np.concatenate(right)
            for k in range(0, n, PAIRS):
                yield a[k:k + PAIRS], c[k:k + PAIRS]
            left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def _sigs(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, VALUES)


def surviving_pairs(t: pa.Table, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    sigs, band = _sigs(t), (t.column("bucket").to_numpy() & 31).astype(np.int64)
    out = [(np.zeros(0, np.int64),) * 2]
    for a, c in candidate_pairs(t):
        own = survivors(sigs, a, c, band[a], least)
        out.append((a[own], c[own]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def shared(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets of a task."""
    if len(left) < 64:
        return np.array([len(np.intersect1d(grams[a], grams[c], assume_unique=True))
                         for a, c in zip(left, right, strict=True)], np.int64)
    rows = np.unique(np.concatenate([left, right]))
    number = {int(r): k for k, r in enumerate(rows)}
    owner = np.repeat(np.arange(len(rows)), [len(grams[r]) for r in rows])
    _, gram, n = np.unique(np.concatenate([grams[r] for r in rows]), return_inverse=True, return_counts=True)
    often = np.cumsum(n > 1) - 1  # a shingle of one set only is in no intersection
    keep = n[gram] > 1
    owner, gram = owner[keep], often[gram[keep]]
    total = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, 4096):
        a, c = np.searchsorted(gram, [low, low + 4096])
        x = np.zeros((len(rows), 4096), np.float32)
        x[owner[a:c], gram[a:c] - low] = 1
        total += x @ x.T
    at = lambda side: np.array([number[int(r)] for r in side])
    return total[at(left), at(right)].round().astype(np.int64)


def _roots(n: int, left: np.ndarray, right: np.ndarray, names: list[bytes]) -> list[int]:
    """For each of n rows, the row of the smallest name its links lead to."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, c in zip(left.tolist(), right.tolist(), strict=True):
        a, c = top(a), top(c)
        if a != c:
            if names[c] < names[a]:
                a, c = c, a
            up[c] = a
    return [top(x) for x in range(n)]


def _members(least: list[int]) -> Callable:
    """Tasks -> the rows that take part in a surviving pair."""
    def run(batches):
        for t in groups(batches):
            a, c = surviving_pairs(t, least)
            rows = np.unique(np.concatenate([a, c]))
            if len(rows):
                yield from t.take(pa.array(rows)).combine_chunks().to_batches()
    return run


_LINKS = pa.schema([("key", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64()), ("root", pa.binary())])


def _links(least: list[int], threshold: float) -> Callable:
    """Tasks with texts -> links of each text and where they lead."""
    def run(batches):
        hashes = WordHashes()
        for many in groups(batches):
            b, i, j = (many.column(k).to_numpy() for k in range(3))
            ends = np.concatenate([np.flatnonzero((b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(b)]])
            out, low = [], 0
            for high in ends.tolist():
                t, low = many.slice(low, high - low), high
                grams = [shingles(x.as_py(), hashes) for x in t.column("text")]
                sizes = np.array([len(g) for g in grams])
                a, c = surviving_pairs(t, least)
                both = shared(grams, a, c)
                linked = both >= threshold * (sizes[a] + sizes[c] - both) - 1e-9
                a, c = a[linked], c[linked]
                if not len(a):
                    continue
                names, copies = t.column("key").to_pylist(), t.column("copies").to_numpy()
                texts = np.bincount(a, minlength=len(t)) + np.bincount(c, minlength=len(t))
                docs = np.bincount(a, copies[c], len(t)) + np.bincount(c, copies[a], len(t))
                roots = _roots(len(t), a, c, names)
                out += [(names[k], int(texts[k]), int(docs[k]), names[roots[k]]) for k in np.flatnonzero(texts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _LINKS, strict=True)],
                                                 schema=_LINKS)
    return run


# --- Spark ------------------------------------------------------------------

def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, empty = WordHashes(), b""
    for batch in batches:
        sigs = []
        for text in batch.column("text"):
            grams = shingles(text.as_py(), hashes)
            sigs.append(signature(grams) if len(grams) else empty)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sigs, pa.binary())],
                                         ["doc_id", "key", "sig"])


def link_texts(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) -> documents (doc_id, key of the text) and
    distinct texts (key, copy_id, copies, root, texts and docs linked)."""
    least = least_matches(threshold)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    named = docs.select("doc_id", "text", text_id(F.col("text")).alias("key"))
    rows = cut(named.mapInArrow(_signed, f"doc_id {kind}, key binary, sig binary"))
    texts = cut(rows.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(
        b, F.substring("sig", b * (2 * ROWS) + 1, F.lit(2 * ROWS))).bitwiseAND(F.lit(-32)).bitwiseOR(b.cast("long")))
    placed = texts.where(F.octet_length("sig") > 0).select("key", F.explode(band).alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = placed.join(full, "bucket").withColumn("m", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("h", F.pmod(F.xxhash64("key", F.lit(8)), F.col("m")).cast("int"))
    met = met.join(texts.select("key", "copies", "sig"), "key")
    tasks = met.select("bucket", "h", "key", "copies", "sig", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    order = ["bucket", "i", "j"]
    schema = "bucket long, i int, j int, h int, key binary, copies long, sig binary"
    tasks = tasks.select("bucket", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), "h", "key", "copies", "sig")
    alive = cut(tasks.repartition(*order).sortWithinPartitions(*order).mapInArrow(_members(least), schema))
    wanted = alive.select("key").distinct()
    bodies = (named.select("key", "text").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    verify = alive.join(bodies, "key").select(*order, "h", "key", "copies", "sig", "text")
    links = cut(verify.repartition(*order).sortWithinPartitions(*order)
                .mapInArrow(_links(least, threshold), "key binary, texts long, docs long, root binary"))
    roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    out = (texts.drop("sig").join(sums, "key", "left").join(roots.withColumnRenamed("a", "key"), "key", "left")
           .select("key", "copy_id", "copies", F.coalesce("root", "key").alias("root"),
                   F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs")))
    return rows.select("doc_id", "key"), cut(out)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of the texts
    its links lead to, directly or not), copy_id (smallest doc_id of its
    copies), copies, n_links (other documents of similarity 0.8 or more,
    copies included), linked_texts (different texts among them)."""
    rows, texts = link_texts(docs, threshold)
    classes = texts.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    texts = texts.join(classes, "root").select("key", "class_id", "copy_id", "copies",
                                               (F.col("docs") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("linked_texts"))
    return rows.join(texts, "key").drop("key")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row
    with the smallest doc_id (nulls last), one of equal rows."""
    _, texts = link_texts(docs, threshold)
    first = F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "key"))
    key, own_id, own_key = free(docs, "t", "id", "key")
    kept = texts.groupBy("root").agg(first.alias("k")).select(F.col("k.key").alias(own_key), F.col("k.copy_id").alias(own_id))
    rows = docs.withColumn(key, text_id(F.col("text")))
    rows = rows.join(kept, (rows[key] == kept[own_key]) & rows["doc_id"].eqNullSafe(kept[own_id]), "left_semi")
    return rows.dropDuplicates([key]).drop(key)
