"""Benchmark decontamination (operator 3) by latent semantic retrieval.

The benchmark is taken in blocks of items. For a block, the corpus is read
once and kept as numbers of the block's words. Over all documents that gives
the words' document frequencies, then the sketch A'A W of the passages' TF-IDF
matrix A (one pass; the tasks' sums are added by a grouped aggregation), from
which the Nystroem form of the randomised SVD follows; the items' own rows are
weighted up to the weight of the whole corpus, so the latent space spans them.
Items longer than WIDE words are searched by their segments. A document is cut
into overlapping windows of 16, 32 or 64 words, after the length of an item,
and each window is folded into the latent space; where its cosine with an item
reaches NEAR, the longest common subsequence of the item's words and the words
around the window decides: COPY of the item's words suffice, from PARAPHRASE on
also ANSWER of the answer's words must be there in order. The answer is the
benchmark's column ``answer`` or else the item's last sentence.

Words of a window that the block doesn't have count in the window's length.
Null and empty texts and items without words match nothing; an empty table
gives an empty result; repeated rows are judged alike, repeated items too."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import cut, free, staged, text_key, words
from vintage.llm.token_output import portions

#: Items searched at a time; bounds the latent space and what is broadcast.
ITEMS = 256
BASE, WIDE = 8, 48
NEAR, COPY, PARAPHRASE, ANSWER = 0.15, 0.8, 0.55, 0.6
#: Words in more than this share of the documents carry no weight, if items have enough others.
COMMON = 0.05
#: What a word outside the block weighs in the length of a window, of the weight of a word seen once.
STRANGE = 0.25
EXTRA = 24
SENTENCE = re.compile(r"[.!?\n]+")


def lcs(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``; 0 in
    ``b`` matches nothing."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for w in b.tolist():
        if m := masks.get(w) if w else None:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def answer_words(text: str, answer: str | None) -> list[str]:
    if answer and words(answer):
        return words(answer)
    sentences = [s for s in map(words, SENTENCE.split(text)) if s]
    last = sentences[-1] if sentences else []
    own = words(text)
    return last if len(last) >= 3 else own[-max(1, len(own) // 4):]


@dataclass
class Block:
    """A block of items as numbers of its words (from 1)."""
    ids: list
    vocabulary: dict[str, int]
    items: list[list[int]]
    answers: list[list[int]]
    segments: list[tuple[int, list[int], int]]  # item, words, half a window

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        vocabulary: dict[str, int] = {}
        number = lambda ws: [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws]
        items = [number(words(text)) for _, text, _ in rows]
        answers = [number(answer_words(text, answer)) for _, text, answer in rows]
        segments = []
        for i, item in enumerate(items):
            parts = -(-len(item) // WIDE)
            for k in range(parts):
                own = item[k * len(item) // parts:(k + 1) * len(item) // parts]
                segments.append((i, own, 8 if len(own) <= 16 else 16 if len(own) <= 32 else 32))
        return cls([r[0] for r in rows], vocabulary, items, answers, segments)

    @property
    def kind(self) -> str:
        return "<u2" if len(self.vocabulary) < 1 << 16 else "<u4"


def encoded(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, _text and the numbers of the words (0: not in the block)."""
    get, code = block.vocabulary.get, "H" if block.kind == "<u2" else "I"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in portions(batch.column(2)):
                ids = [array(code, [get(w, 0) for w in words(t)]).tobytes() for t in texts]
                own = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(ids, pa.binary())],
                                                 ["doc_id", "_text", "ids"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, _text long, ids binary")


def _batches_of(batch: pa.RecordBatch, kind: str, limit: int = 400_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Documents of a batch as arrays, about ``limit`` words at a time."""
    own, held, first = [], 0, 0
    for n, raw in enumerate(batch.column("ids")):
        own.append(np.frombuffer(raw.as_buffer(), kind))
        held += len(own[-1])
        if held >= limit:
            yield first, own
            own, held, first = [], 0, n + 1
    if own:
        yield first, own


def frequencies(corpus: DataFrame, block: Block) -> tuple[int, np.ndarray]:
    """Documents, and how many have each word of the block."""
    size, kind = len(block.vocabulary) + 1, block.kind

    def run(batches):
        total, docs = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, own in _batches_of(batch, kind):
                docs += len(own)
                for ids in own:
                    total[np.unique(ids)] += 1
        total[0] = docs
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["word", "n"])

    rows = corpus.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["word"]] = rows["n"]
    docs, out[0] = int(out[0]), 0
    return docs, out


def _laid_out(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents one after another, each filled up to whole blocks of 32
    words and one more; and where each begins."""
    room = [-(-len(x) // 32) * 32 + 32 for x in own]
    starts = np.cumsum([0, *room])
    out = np.full(starts[-1], -1, np.int64)
    for x, at in zip(own, starts.tolist()):
        out[at:at + len(x)] = x
    return out, starts


def sketch(corpus: DataFrame, block: Block, weight: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, float]:
    """A'A ``test`` and |A|^2, summed over all passages of 32 words."""
    kind, rows_each = block.kind, 256

    def run(batches):
        total, energy = np.zeros(test.shape, np.float32), 0.0
        scaled = (test * weight[:, None]).astype(np.float32)
        for batch in batches:
            for _, own in _batches_of(batch, kind, 100_000):
                ids, _ = _laid_out(own)
                where = np.flatnonzero((ids > 0) & (weight[ids] > 0))
                if not len(where):
                    continue
                word, passage = ids[where], where // 32
                first = np.concatenate([[0], np.flatnonzero(np.diff(passage)) + 1])
                y = np.add.reduceat(scaled[word], first)  # A test, by passage
                order = np.argsort(word.astype(np.uint32), kind="stable")
                by = word[order]
                edge = np.concatenate([[0], np.flatnonzero(np.diff(by)) + 1])
                back = np.repeat(np.arange(len(first)), np.diff([*first, len(where)]))[order]
                total[by[edge]] += np.add.reduceat(y[back], edge) * weight[by[edge], None]
                energy += float((weight[word] ** 2).sum())
        yield pa.RecordBatch.from_arrays([
            pa.array([-1, *range(0, len(total), rows_each)], pa.int64()),
            pa.array([np.float64(energy).tobytes(), *(total[i:i + rows_each].tobytes() for i in range(0, len(total), rows_each))],
                     pa.binary())], ["part", "raw"])

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        kind = np.float64 if part < 0 else np.float32
        out = sum(np.frombuffer(x.as_buffer(), kind) for x in table.column("raw"))
        return pa.table({"part": pa.array([part], pa.int64()), "raw": pa.array([out.tobytes()], pa.binary())})

    sums = corpus.mapInArrow(run, "part long, raw binary").groupBy("part").applyInArrow(add, "part long, raw binary")
    rows = {r["part"]: bytes(r["raw"]) for r in sums.collect()}
    if not rows:
        return np.zeros(test.shape, np.float32), 0.0
    energy = float(np.frombuffer(rows.pop(-1), np.float64)[0])
    return np.vstack([np.frombuffer(rows[k], np.float32).reshape(-1, test.shape[1]) for k in sorted(rows)]), energy


def latent_directions(corpus: DataFrame, block: Block, weight: np.ndarray, seed: int = 3) -> np.ndarray:
    """For each word, its share in the cosine with each segment: words x
    segments, folded through the latent space."""
    n = len(block.segments)
    own = np.zeros((n, len(weight)), np.float32)
    for k, (_, ws, _) in enumerate(block.segments):
        np.add.at(own[k], ws, weight[ws])
    test = np.random.default_rng(seed).normal(size=(len(weight), min(len(weight), n + EXTRA))).astype(np.float32)
    gram, energy = sketch(corpus, block, weight, test)
    lift = max(1.0, energy / max(1e-9, float((own ** 2).sum())))
    gram = gram.astype(float) + lift * (own.T.astype(float) @ (own.astype(float) @ test.astype(float)))
    # Nystroem: gram (test' gram)^-1 gram' has the leading singular vectors of A
    core = test.T.astype(float) @ gram
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-10
    space, _, _ = np.linalg.svd(gram @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    items = own @ space
    length = np.linalg.norm(items, axis=1, keepdims=True)
    unit = np.divide(items, length, out=np.zeros_like(items), where=length > 0)
    return ((space @ unit.T) * weight[:, None]).astype(np.float32)


_FOUND = pa.schema([("_text", pa.int64()), ("item", pa.int64()), ("position", pa.int64()), ("cosine", pa.float64()),
                    ("lcs", pa.float64()), ("answer", pa.float64())])


def _judged(ids: np.ndarray, hits: list[tuple[int, int, float]], block: Block) -> dict[int, tuple]:
    """Hits (segment, word, cosine) in one document -> the best by item."""
    best: dict[int, tuple] = {}
    for k, at, cosine in sorted(hits, key=lambda h: -h[2]):
        i, _, half = block.segments[k]
        if i in best and best[i][2] == 1:
            continue
        item, reach = block.items[i], len(block.items[i])
        low, high = max(0, at - reach), at + 2 * half + reach
        around = ids[low:high]
        share = lcs(item, around) / reach
        if share < PARAPHRASE or i in best and best[i][2] >= share:
            continue
        answer = lcs(block.answers[i], around) / len(block.answers[i])
        if share >= COPY or answer >= ANSWER:
            best[i] = (at, cosine, share, answer)
    return best


def search(corpus: DataFrame, block: Block, weight: np.ndarray, towards: np.ndarray, strange: float) -> DataFrame:
    """Documents with an item of the block: doc_id, _text, item (its number
    in the block), position (word of the window), cosine, lcs, answer."""
    spark, kind = corpus.sparkSession, block.kind
    shared = spark.sparkContext.broadcast((block, weight, towards))

    def run(batches):
        block, weight, towards = shared.value
        square = np.concatenate([weight ** 2, [0.0]]).astype(np.float32)
        square[0] = strange ** 2
        useful = np.concatenate([weight > 0, [False]])
        scales = []
        for half in (8, 16, 32):
            cols = np.flatnonzero([h == half for _, _, h in block.segments])
            if len(cols):
                scales.append((half, cols, np.ascontiguousarray(towards[:, cols])))
        for batch in batches:
            out, docs = [], []
            for first, own in _batches_of(batch, kind, 60_000):
                ids, starts = _laid_out(own)
                length = square[ids].reshape(-1, BASE).sum(1)
                where = np.flatnonzero(useful[ids])
                if not len(where):
                    continue
                word, hits = ids[where], {}
                for half, cols, part in scales:
                    cell = where // half
                    edge = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
                    d = np.zeros((len(ids) // half, len(cols)), np.float32)
                    d[cell[edge]] = np.add.reduceat(part[word], edge)
                    size = length.reshape(-1, half // BASE).sum(1)
                    cosine = (d[:-1] + d[1:]) / np.sqrt(size[:-1] + size[1:] + 1e-9)[:, None]
                    for w, c in zip(*np.nonzero(cosine >= NEAR), strict=True):
                        doc = int(np.searchsorted(starts, w * half, "right")) - 1
                        hits.setdefault(doc, []).append((int(cols[c]), int(w * half - starts[doc]), float(cosine[w, c])))
                for doc, found in hits.items():
                    for i, (at, cosine, share, answer) in _judged(own[doc], found, block).items():
                        out.append((i, at, cosine, share, answer))
                        docs.append(first + doc)
            if out:
                own = batch.take(pa.array(docs))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(_FOUND)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("_text"), *cols], ["doc_id", *_FOUND.names])

    kind_of = dict(corpus.select("doc_id").dtypes)["doc_id"]
    return corpus.mapInArrow(run, f"doc_id {kind_of}, _text long, item long, position long, cosine double, lcs double, answer double")


def item_blocks(benchmark: DataFrame, items: int = ITEMS) -> Iterator[Block]:
    """The benchmark (item_id, text, perhaps answer), ``items`` at a time."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows, own = benchmark.select("item_id", "text", answer.alias("answer")).orderBy("item_id").toLocalIterator(), []
    for r in rows:
        if words(r["text"]):
            own.append(tuple(r))
        if len(own) == items:
            yield Block.of(own)
            own = []
    if own:
        yield Block.of(own)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: doc_id, _text (hash of the
    text), item_id, position, cosine, lcs, answer (shares of their words)."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes) | {f"b.{c}": t for c, t in benchmark.dtypes}
    schema = (f"doc_id {kinds['doc_id']}, _text long, item_id {kinds['b.item_id']}, position long, "
              "cosine double, lcs double, answer double")
    found = None
    for block in item_blocks(benchmark):
        corpus = cut(encoded(docs, block))
        n, df = frequencies(corpus, block)
        weight = np.log((n + 1) / (df + 1)).clip(0)
        rare = np.where(df > COMMON * n, 0.0, weight)
        if all(sum(rare[w] > 0 for w in ws) >= min(3, len(ws)) for _, ws, _ in block.segments):
            weight = rare
        else:
            weight = weight + 0.05
        weight[0] = 0
        weight = weight.astype(np.float32)
        towards = latent_directions(corpus, block, weight)
        rows = search(corpus, block, weight, towards, STRANGE * float(np.log(n + 1)))
        names = spark.createDataFrame(pd.DataFrame({"item": range(len(block.ids)), "item_id": block.ids}),
                                      f"item long, item_id {kinds['b.item_id']}")
        rows = rows.join(names, "item").select("doc_id", "_text", "item_id", "position", "cosine", "lcs", "answer")
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    key, own_id, own_key = free(docs, "t", "id", "key")
    bad = staged(contaminated(docs, benchmark).select(F.col("doc_id").alias(own_id), F.col("_text").alias(own_key)).distinct(), "leaks")
    rows = docs.withColumn(key, text_key(F.col("text")))
    return rows.join(bad, (rows[key] == bad[own_key]) & rows["doc_id"].eqNullSafe(bad[own_id]), "left_anti").drop(key)
