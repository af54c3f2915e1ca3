"""Token-ID output (operator 10): raw id files with a minimal perfect hash.

A shard file holds the ids of its documents back to back as little-endian
unsigned integers (16 bits wide if the vocabulary fits, else 32), each
document closed by the end id, in ascending doc_id order over all shards.
After the payload comes a directory: document lengths, keys in file order, a
minimal perfect hash of the keys (levels of bit arrays after Limasset et al.
2017) and, by hash slot, a 32-bit fingerprint of the key and the number of
its first document. A key is found with a few probes: slot, fingerprint,
offset. Keys that were never stored are refused by their fingerprint, but for
one in 2**32.

Spark's own text writer writes the files: the end id is its line separator,
so a row's bytes plus separator are the document's ids. Its commit protocol
holds when tasks are repeated, and any Hadoop file system serves.

Null texts are empty documents (the end id alone). Null doc_ids come first
and have no key: they are read back in order but can't be looked up. Rows
that share a doc_id stand next to each other, ordered by a hash of the text,
and one lookup gives them all. An empty table gives no files."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintage.llm.common import cut, text_key
from vintage.llm.token_alignment import byte_alphabet

MAGIC = b"VTGIDS01"
TAIL = struct.Struct("<QQ8s")  # directory bytes, payload bytes, magic
#: Text bytes a shard file takes, about; a longer document has a longer file.
SHARD_BYTES = 12 << 20
#: Words whose ids a worker remembers, and words that the model merges in one call.
REMEMBERED, TOGETHER = 100_000, 32
#: How byte-level vocabularies write the space.
SPACE = "Ġ"
#: Byte -> the character that byte-level vocabularies write for it.
CHARS = {b: c for c, b in byte_alphabet().items()}
BYTE_CHARS = np.array([ord(CHARS[b]) for b in range(256)], "<u2")
#: No pre-token of byte-level BPE reaches over a space that a non-space follows.
BEFORE_WORD = re.compile(r" (?=\S)")
OPEN_SPACE = re.compile(r" (?:\s|\Z)")
#: Letters, and other signs of number that `isalpha` refuses.
STEM = re.compile(r"[^\W\d_]+")


# --- minimal perfect hash ---------------------------------------------------

def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of the keys, one function for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        self.ranks, below = [], 0
        for bits in levels:
            self.ranks.append(below + np.cumsum(bits) - bits)
            below += int(bits.sum())
        self.n = below

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys.astype(np.uint64)
        while len(rest):
            at = mix(rest, len(levels)) % np.uint64(2 * len(rest))
            hits = np.bincount(at.astype(np.int64), minlength=2 * len(rest))
            levels.append(hits == 1)
            rest = rest[hits[at.astype(np.int64)] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 or any slot for a key that isn't there."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(rest):
                break
            at = (mix(keys[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


# --- shard files ------------------------------------------------------------

def directory(keys: list[int | None], lengths: list[int], payload: int) -> bytes:
    """Directory and tail of a shard; keys ascend, nulls first."""
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], "<i8")
    own, first = np.unique(known, return_index=True)
    mph = PerfectHash.build(own.view("<u8"))
    slot = mph.slots(own.view("<u8"))
    prints, docs = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    prints[slot], docs[slot] = fingerprints(own.view("<u8")), first + nulls
    parts = [struct.pack("<IIII", len(keys), nulls, len(own), len(mph.levels)), np.array(lengths, "<u4").tobytes(),
             known.tobytes(), prints.tobytes(), docs.tobytes()]
    for bits in mph.levels:
        parts += [struct.pack("<I", len(bits)), np.packbits(bits).tobytes()]
    body = b"".join(parts)
    return body + TAIL.pack(len(body), payload, MAGIC)


class Shard:
    """A shard file read back. ``width``: bytes of an id."""

    def __init__(self, content: bytes | pa.Buffer, width: int):
        content = memoryview(content)
        size, payload, magic = TAIL.unpack_from(content, len(content) - width - TAIL.size)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = len(content) - width - TAIL.size - size
        self.ids = np.frombuffer(content, f"<u{width}", payload // width)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(content, kind, n, at)
            at += a.nbytes
            return a

        n, self.nulls, own, levels = (int(x) for x in take("<u4", 4))
        self.lengths = take("<u4", n).astype(np.int64)
        self.keys = take("<i8", n - self.nulls)
        self.prints, self.docs, bits = take("<u4", own), take("<u4", own), []
        for _ in range(levels):
            m = int(take("<u4", 1)[0])
            bits.append(np.unpackbits(take("u1", (m + 7) // 8), count=m).astype(bool))
        self.mph = PerfectHash(bits)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's first document, -1 if the key isn't there."""
        keys = np.asarray(keys, "<i8").view("<u8")
        slot = self.mph.slots(keys)
        if not len(self.docs):
            return slot
        found = (slot >= 0) & (self.prints[slot] == fingerprints(keys))
        return np.where(found, self.docs[slot].astype(np.int64), -1)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i]:self.starts[i] + self.lengths[i]]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, ids before it in the shard, ids): keyed access for every
        stored key, repeats of a key following its first document."""
        for i in range(self.nulls):
            yield None, int(self.starts[i]), self.document(i)
        firsts, seen, step = self.find(self.keys), None, 0
        for k, i in zip(self.keys.tolist(), firsts.tolist(), strict=True):
            step = step + 1 if k == seen else 0
            seen = k
            yield k, int(self.starts[i + step]), self.document(i + step)


# --- encoding ---------------------------------------------------------------

def byte_level(data: bytes | pa.Buffer) -> str:
    """UTF-8 as byte-level vocabularies write it: a character for each byte."""
    return BYTE_CHARS[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le")


class Split:
    """Some texts cut at spaces before non-spaces (which are dropped): all
    pieces, one text after the other, and how many each text has."""

    def __init__(self, texts: list[str]):
        marks = map(chr, chain(range(1, 9), range(14, 32), range(0xE000, 0xF900)))
        mark = next(c for c in marks if not any(c in t for t in texts))
        cut = pa.array([BEFORE_WORD.sub(mark, t) if OPEN_SPACE.search(t) else t.replace(" ", mark) for t in texts], pa.large_string())
        parts = pc.split_pattern(cut, mark)
        self.pieces, self.n, self.chars = parts.flatten(), np.diff(parts.offsets.to_numpy()), sum(map(len, texts))


class Pieces:
    """Ids of texts by their words. Each distinct word of a block of texts is
    encoded once; the most frequent ones, up to REMEMBERED, stay for the blocks
    that follow: ``known``, with the bytes of the ids of " " + word in
    ``known_ids``."""

    def __init__(self, path: str, width: int):
        self.kind, self.tokenizer = np.dtype(f"<u{width}"), load_tokenizer(path)
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE)
                               for i in range(self.tokenizer.get_vocab_size())])
        self.known, self.known_ids = pa.array([], pa.large_string()), self.binary([], [])

    def binary(self, ids: Sequence[int], n: Sequence[int]) -> pa.LargeBinaryArray:
        """Bytes of the ids of each word: ``n`` of them, one word after the other."""
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) * self.kind.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.array(ids, self.kind))])

    def one_by_one(self, pieces: list[str]) -> pa.LargeBinaryArray:
        ids, n = array("I"), array("I")
        for i in range(0, len(pieces), 1_000):
            for e in self.tokenizer.encode_batch_fast(pieces[i:i + 1_000], add_special_tokens=False):
                ids.extend(own := e.ids)
                n.append(len(own))
        return self.binary(ids, n)

    def letters(self, words: pa.Array) -> pa.LargeBinaryArray:
        """Ids of " " + word for words of letters, each of them one pre-token,
        from the tokenizer's model itself, TOGETHER in a call. Where an id's
        token opens with a space the next word begins, as no merge reaches
        over a space between letters; if calls show another number of words,
        all are made word by word."""
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words, pa.scalar("", pa.large_string()))
        ends = np.frombuffer(spaced.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
        text = byte_level(spaced.buffers()[2]) if len(words) else ""
        for size in (TOGETHER, 1):
            ids, n, tokenize = array("I"), array("I"), self.tokenizer.model.tokenize
            cuts = [*ends[:-1:size].tolist(), len(text)]
            for low, high in pairwise(cuts):
                found = tokenize(text[low:high])
                ids.extend([t.id for t in found])
                n.append(len(found))
            every, calls = np.array(ids), np.cumsum(n, dtype=np.int64)
            at = np.flatnonzero(self.opens[every])
            words_of = np.diff(np.searchsorted(at, calls), prepend=0)
            wanted = np.diff(np.append(np.arange(0, len(words), size), len(words)))
            if size == 1 or (words_of == wanted).all() and self.opens[every[calls - n]].all():
                break
        return self.binary(every, n if size == 1 else np.diff(np.append(at, len(every))))

    def learn(self, words: pa.Array) -> pa.LargeBinaryArray:
        """Ids of " " + word for distinct words. The letters a word begins with
        are one pre-token with the space; what follows is encoded apart."""
        plain = pc.utf8_is_alpha(words)
        stems, rests, stem_of, rest_of = {}, {"": 0}, array("i"), array("i")
        for w in words.filter(pc.invert(plain)).to_pylist():
            stem = m[0] if (m := STEM.match(w)) and m[0].isalpha() else ""
            stem_of.append(stems.setdefault(stem, len(stems)) if stem else -1)
            rest_of.append(rests.setdefault(w[len(stem):] if stem else " " + w, len(rests)))
        alone, own = words.filter(plain), pa.array(list(stems), pa.large_string())
        held = pc.index_in(own, pa.concat_arrays([self.known, alone]))
        new = own.filter(held.is_null())
        held, stay = held.fill_null(-1).to_numpy().astype(np.int64), len(self.known) + len(alone)
        held[held < 0] = stay + np.arange(len(new))
        held = np.append(held, stay + len(new))  # the last one is empty
        table = pa.concat_arrays([self.known_ids, self.letters(pa.concat_arrays([alone, new])), self.binary([], [0])])
        marked = pc.binary_join_element_wise(table.take(pa.array(held[np.array(stem_of)])), self.one_by_one(list(rests)).take(pa.array(np.array(rest_of))),
                                             pa.scalar(b"", pa.large_binary()))
        plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(plain, np.cumsum(plain), len(alone) + np.cumsum(~plain)) - 1
        return pa.concat_arrays([table.slice(len(self.known), len(alone)), marked]).take(pa.array(place))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Bytes of the ids of each text."""
        return self.encode_all([Split(texts)]).to_pylist()

    def encode_all(self, block: list[Split]) -> pa.LargeBinaryArray:
        """Bytes of the ids of each text of a block."""
        pieces = pa.chunked_array([x.pieces for x in block], pa.large_string()).dictionary_encode()
        own = pieces.chunk(0).dictionary
        code = np.concatenate([x.indices.to_numpy() for x in pieces.chunks])
        n = np.concatenate([x.n for x in block])
        del pieces
        at = np.cumsum(n) - n
        times = np.bincount(code, minlength=len(own))
        first, which = np.unique(code[at], return_inverse=True)
        times[first] -= np.bincount(which)  # no space stands before the first piece of a text
        used = np.flatnonzero(times)
        words = own.take(pa.array(used))
        found = pc.index_in(words, self.known)
        new, found = words.filter(found.is_null()), found.fill_null(-1).to_numpy().astype(np.int32)
        learned, stay = self.learn(new), len(self.known)
        table = pa.concat_arrays([self.known_ids, learned, self.one_by_one(own.take(pa.array(first)).to_pylist())])
        fresh = found < 0
        found[fresh] = stay + np.arange(len(new))
        number = np.zeros(len(own), np.int32)
        number[used] = found
        number = number[code]
        number[at] = stay + len(new) + which
        taken = table.take(pa.array(number))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(number) + 1)[np.append(at, len(number))]
        if stay < REMEMBERED:
            again = times[used[fresh]]
            keep = np.argsort(-again, kind="stable")[:min(REMEMBERED - stay, int((again > 1).sum()))]
            self.known = pa.concat_arrays([self.known, new.take(pa.array(keep))])
            self.known_ids = pa.concat_arrays([self.known_ids, learned.take(pa.array(keep))])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), taken.buffers()[2]])


_PIECES: dict[tuple[str, int], Pieces] = {}


#: Characters a worker cuts into words at a time, as Python strings.
PORTION = 1 << 19
#: Characters whose words a worker collects before it encodes them.
BLOCK = 1 << 20


def portions(texts: pa.Array, size: int = PORTION) -> Iterator[list[str]]:
    """The texts (null: empty) in lists of about ``size`` characters."""
    own, held = [], 0
    for text in texts:
        own.append(text.as_py() or "")
        held += len(own[-1])
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


def blocks(texts: Iterator[Split], size: int | None = None) -> Iterator[list[Split]]:
    """Portions in lists of about ``size`` characters."""
    own, held = [], 0
    for split in texts:
        own.append(split)
        held += split.chars
        if held >= (size or BLOCK):
            yield own
            own, held = [], 0
    if own:
        yield own


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; threads hold memory of their own
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def id_width(path: str) -> int:
    return 2 if load_tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2,
                      shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizers file ``tokenizer``
    and write shard files to the folder ``out``."""
    width = id_width(tokenizer)
    end = end_id.to_bytes(width, "little")
    if max(end) > 127:
        raise ValueError("each byte of the end id must be ASCII, as it is written as the line separator")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, width) not in _PIECES:
            _PIECES[tokenizer, width] = Pieces(tokenizer, width)
        pieces = _PIECES[tokenizer, width]
        keys, lengths, payload = [], [], 0

        def texts() -> Iterator[Split]:
            for batch in batches:
                keys.extend(batch.column(0).to_pylist())
                yield from map(Split, portions(batch.column(1)))

        for block in blocks(texts()):
            rows = pieces.encode_all(block)
            n = pc.binary_length(rows).to_numpy() // width + 1
            lengths += n.tolist()
            payload += int(n.sum()) * width
            at = 0
            for split in block:  # batches as small as the portions: both sides hold one whole
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(split.n)).cast(pa.binary())], ["ids"])
                at += len(split.n)
        pa.default_memory_pool().release_unused()  # the batches are done
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([directory(keys, lengths, payload)], pa.binary())], ["ids"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text")]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("_text"))
     .repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(encode, "ids binary").select(F.col("ids").cast("string").alias("value"))
     .write.option("lineSep", end.decode("ascii")).text(out))


def _number(name: Column) -> Column:
    """A shard's place: the writer's task number, which needs not have five digits."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def _shard_files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .where(F.col("length") > 0).select(F.substring_index("path", "/", -1).alias("shard"), "content"))


DOCUMENT = T.StructType([T.StructField("shard", T.StringType()), T.StructField("number", T.LongType()),
                         T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                         T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_token_files(spark: SparkSession, path: str, width: int) -> DataFrame:
    """One row per stored document, by keyed access to each shard: shard,
    number in the shard, doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as 32-bit little-endian)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _PIECES.clear()  # a worker that has encoded needs its words no more
        pa.default_memory_pool().release_unused()
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                shard, rows = Shard(content.as_buffer(), width), []
                for i, (k, at, ids) in enumerate(shard.documents()):
                    rows.append((name.as_py(), i, k, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 20_000 or i + 1 == len(shard.lengths):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] + [pa.int64()] * 5, strict=True)],
                            names=DOCUMENT.names)
                        rows = []

    rows = cut(_shard_files(spark, path).mapInArrow(read, DOCUMENT))
    before = W.orderBy(_number(F.col("shard"))).rowsBetween(W.unboundedPreceding, -1)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    shards = shards.select("shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    return (rows.join(shards, "shard")
            .select("shard", "number", "doc_id", (F.col("_base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


def lookup(spark: SparkSession, path: str, keys: DataFrame, width: int) -> DataFrame:
    """Ids of the documents of ``keys`` (doc_id): doc_id, ids. A shard's
    directory answers the keys that fall into its key range."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                k = Shard(content.as_buffer(), width).keys
                if len(k):
                    yield pa.RecordBatch.from_pylist([{"shard": name.as_py(), "low": int(k[0]), "high": int(k[-1])}])

    def fetch(_, left, right):
        import pandas as pd
        out, own = [], left["doc_id"].to_numpy() if len(right) else np.zeros(0, np.int64)
        shard = Shard(right["content"].iloc[0], width) if len(own) else None
        for k, i in zip(own.tolist(), shard.find(own).tolist() if shard else [], strict=True):
            while 0 <= i < len(shard.lengths) and shard.keys[i - shard.nulls] == k:
                out.append((k, shard.document(i).tolist()))
                i += 1
        return pd.DataFrame({"doc_id": pd.Series([k for k, _ in out], dtype="int64"),
                             "ids": pd.Series([x for _, x in out], dtype=object)})

    files = _shard_files(spark, path)
    table = cut(files.mapInArrow(ranges, "shard string, low long, high long"))
    asked = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    asked = asked.join(table, F.col("doc_id").between(F.col("low"), F.col("high"))).select("shard", "doc_id")
    return asked.groupBy("shard").cogroup(files.groupBy("shard")).applyInPandas(fetch, "doc_id long, ids array<int>")
