"""Document fingerprints (operator 6): a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to
a wide vector and the fingerprint is the sum of the vectors, lane by lane
modulo a power of two. So it doesn't depend on the order of the paragraphs,
and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts. EXACT lanes of 64 bits come from the paragraph's
bytes and settle equality. LIKE lanes of 32 bits are the sum of sign vectors
(+1 or -1 in every lane) of the paragraph's word pairs (of its word, if it has
one): a tug-of-war sketch, in which inner products of sums estimate how many
word pairs two texts share. `likeness` needs the two fingerprints only. A
pair's signs come from all 64 bits of its hash. The estimate is off by about
1 / sqrt(LIKE), so 0.1, as a standard error at any length, and twice that
occurs; equality is not touched by that.

Null texts count as empty; the empty text is one empty paragraph. Documents
are ordered by descending doc_id (nulls last), rows of one doc_id by a hash of
the text; equal rows are interchangeable. An empty table gives an empty
result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.llm.common import WordHashes, cut, text_key, words

EXACT, LIKE = 4, 96
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
#: Words hashed at a time; bounds the memory that a long text takes.
CHUNK = 20_000


def _lanes(pairs: np.ndarray) -> np.ndarray:
    """Sum of the sign vectors of 64-bit hashes, which are mixed again
    (splitmix64) for every 64 lanes."""
    out = []
    for k in range(0, LIKE, 64):
        x = pairs + np.uint64((k // 64 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        raw = (x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.unpackbits(raw[:, :(min(64, LIKE - k) + 7) // 8], axis=1).sum(0, dtype=np.int32)
        out.append(2 * ones[:LIKE - k] - np.int32(len(pairs)))
    return np.concatenate(out)


_STATE: dict[str, object] = {}


class Sum:
    """Sum of paragraph vectors."""

    def __init__(self, exact: np.ndarray | None = None, like: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.like = np.zeros(LIKE, np.int32) if like is None else like

    def __add__(self, other: Sum) -> Sum:
        with np.errstate(over="ignore"):
            return Sum(self.exact + other.exact, self.like + other.like)

    def __sub__(self, other: Sum) -> Sum:
        with np.errstate(over="ignore"):
            return Sum(self.exact - other.exact, self.like - other.like)

    def __bytes__(self) -> bytes:
        return self.exact.astype(">u8").tobytes() + self.like.astype(">i4").tobytes()

    def __str__(self) -> str:
        return bytes(self).hex()

    @classmethod
    def parse(cls, fingerprint: str) -> Sum:
        raw = bytes.fromhex(fingerprint)
        return cls(np.frombuffer(raw[:EXACT * 8], ">u8").astype(np.uint64),
                   np.frombuffer(raw[EXACT * 8:], ">i4").astype(np.int32))


def sum_of(paragraphs: list[str]) -> Sum:
    """Sum of the vectors of ``paragraphs``."""
    if not _STATE:
        _STATE["hashes"] = WordHashes()
    hashes = _STATE["hashes"]
    out = Sum()
    if not paragraphs:
        return out
    raw = [p.encode("utf-8", "surrogatepass") for p in paragraphs]
    lanes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(r, s) for r in raw for s in (0, 1)]), ">u8")
    with np.errstate(over="ignore"):
        out.exact += lanes.reshape(-1, EXACT).sum(0, dtype=np.uint64)
        lines = [words(p) for p in paragraphs]
        held, owner = [], []
        for i, line in enumerate(lines):
            for j in range(0, max(len(line) - 1, 1 if line else 0), CHUNK):
                part = line[j:j + CHUNK + 1]
                held += part
                owner += [2 * i + j // CHUNK % 2] * len(part)
                if len(held) >= CHUNK:
                    _add_pairs(out, held, owner, hashes)
                    held, owner = [], []
        if held:
            _add_pairs(out, held, owner, hashes)
    return out


def _add_pairs(out: Sum, flat: list[str], owner: list[int], hashes: WordHashes) -> None:
    h, own = np.array([hashes[w] for w in flat], np.uint64), np.array(owner)
    same = own[1:] == own[:-1]
    pairs = (h[:-1] * _ODD + h[1:])[same] * _OTHER
    lone = np.ones(len(h), bool)
    lone[1:] &= ~same
    lone[:-1] &= ~same
    out.like += _lanes(np.concatenate([pairs, h[lone] * _OTHER]))


def fingerprint(text: str | None) -> str:
    return str(sum_of((text or "").split("\n")))


def likeness(a: Sum, b: Sum) -> float:
    """Estimated share of word pairs two texts have in common (0 to 1)."""
    if np.array_equal(a.exact, b.exact):
        return 1.0
    x, y = a.like.astype(float), b.like.astype(float)
    both = float(x @ x + y @ y)
    return min(1.0, max(0.0, 2 * float(x @ y) / both)) if both else 0.0


class Hashed:
    """A text with the sum over its paragraphs and over the first of them."""

    def __init__(self, doc_id: int | None, text: str, heads: tuple[int, ...] = ()):
        self.doc_id, self.text, self.lines = doc_id, text, text.split("\n")
        self.half = len(text) - len(text) // 2
        kept = text.count("\n", 0, self.half)
        marks = sorted({0, kept, len(self.lines), *(min(h, len(self.lines)) for h in heads)})
        self.upto, total = {0: Sum()}, Sum()
        for low, high in zip(marks, marks[1:]):
            self.upto[high] = total = total + sum_of(self.lines[low:high])
        self.sum, self.kept = total, self.upto[kept]


def edit(doc: Hashed, text: str) -> tuple[int, tuple[int, ...]]:
    """How many code points of the next document's ``text`` are taken, and
    the paragraph counts whose sums are needed for that."""
    n = min(len(doc.text) // 2, len(text))
    breaks = text.count("\n", 0, n)
    return breaks, (1, breaks) if breaks else ()


def finish(doc: Hashed, nxt: Hashed, breaks: int) -> tuple:
    """Result row of ``doc``: paragraphs after the cut are deleted, those that
    the next document lends inserted."""
    lent = nxt.text[:len(doc.text) // 2]
    left = doc.text[doc.text.rfind("\n", 0, doc.half) + 1:doc.half]
    first, _, _ = lent.partition("\n")
    edited = doc.kept + sum_of([left + first])
    if breaks:
        edited = edited + (nxt.upto[breaks] - nxt.upto[1]) + sum_of([lent[lent.rfind("\n") + 1:]])
    whole = doc.text[:doc.half] + lent
    return (doc.doc_id, len(doc.text), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(),
            bytes(doc.sum), bytes(edited), likeness(doc.sum, edited), likeness(doc.sum, nxt.sum))


#: The fingerprints stay raw bytes up to the result, where they are written in hex.
ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
       "near_edited double, near_next double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()),
                    ("near_next", pa.float64()), ("slice", pa.int32()), ("end", pa.string()), ("text", pa.string())])
_BLANK = (None,) * 6


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs neighbours of a sorted slice; its first and last document are
    handed on with their texts."""
    from pyspark import TaskContext
    own, last = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            doc_id, text = doc_id.as_py(), text.as_py() or ""
            if last is None:
                last = Hashed(doc_id, text)
                rows.append((doc_id, *_BLANK, own, "head", text))
                continue
            breaks, heads = edit(last, text)
            nxt = Hashed(doc_id, text, heads)
            rows.append((*finish(last, nxt, breaks), own, None, None))
            last = nxt
            if len(rows) >= 2000:
                yield _batch(rows, _ARROW)
                rows = []
        if rows:
            yield _batch(rows, _ARROW)
    if last is not None:
        yield _batch([(last.doc_id, *_BLANK, own, "tail", last.text)], _ARROW)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([_ARROW.field(i) for i in range(7)])
    for batch in batches:
        rows = []
        for doc_id, text, next_id, lent in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            doc = Hashed(doc_id, text)
            breaks, heads = edit(doc, lent)
            rows.append(finish(doc, Hashed(next_id, lent, heads), breaks))
        if rows:
            yield _batch(rows, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints in hex. The texts are shuffled once, by
    range of doc_id; only the documents at the slices' ends are joined."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("_text").desc()]
    sliced = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("_text"))
              .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    done = cut(sliced.mapInArrow(_within, f"{ROW}, slice int, end string, text string"))
    names = [x.split()[0] for x in ROW.split(", ")]
    heads = done.where("end = 'head'").select("slice", F.col("doc_id").alias("next_id"), F.col("text").alias("lent"))
    w = W.orderBy("slice")
    follow = heads.select("slice", F.coalesce(F.lead("slice").over(w), F.first("slice").over(
        w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("following"))
    ends = (done.where("end = 'tail'").select("doc_id", "text", "slice").join(follow, "slice")
            .join(heads.withColumnRenamed("slice", "following"), "following").select("doc_id", "text", "next_id", "lent"))
    rows = done.where("end is null").select(*names).unionByName(ends.mapInArrow(_across, ROW))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
