"""Cross-tokenizer alignment (operator 13) with external spill counting.

A text is encoded by a byte-level BPE (A, with a space in front) and by a
sentencepiece model (B, which adds it). Both cut the same bytes; offsets where
both end a token cut them into groups, and an A and a B token that overlap are
linked. Every cut of either side ends one such overlap, so the links of a text
are the union of its cuts.

Counting how many documents hold an id pair linked needs all documents. Tasks
collect (pair, document, links) records; whenever SPILL of them are there they
are sorted, dealt out by the A id (RADIX ways) and written as zstd runs of
blocks, as rows of a table in the shared folder. Tasks that read whole
portions of documents take all runs of one radix and one portion and merge
them: a heap of the blocks' last keys says up to where the loaded blocks can
be merged, so each run has one block in memory. A first merge counts the pairs
of a portion; Spark sums the counts of all portions; in A-major order a scan of
the sums finds the highest count of each A id. A second merge of the same runs
brings count and maximum to each record and adds them up by document.

Texts are cut at spaces that stand alone before a non-space. No token of A
reaches over such a place, and none of B if its vocabulary has no piece with a
space after another character (`Encoders.by_word` looks). Both sides so begin a
token there: the alignment of a text is that of its words, one after the other,
and a task aligns each of the words it remembers once. Other vocabularies are
aligned by whole texts.

A hot pair is split by portions, whose size (PORTION_BYTES, PORTION_DOCS) bounds
what a task holds; the sums have a row for each pair that occurs.

A document is a row: repeated rows count each. Null and empty texts, and texts
whose A or B bytes don't join to space + text, have no tokens: zeros and an
empty ``groups_sha256``. Rows of a null doc_id are rows like others. An empty
table gives an empty result."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import cut, scratch

#: Ways by A id; records a task holds before it writes a run; records of a block.
RADIX, SPILL, RUN_BLOCK = 16, 1 << 21, 1 << 14
#: Text and documents whose runs one task may merge.
PORTION_BYTES, PORTION_DOCS = 1 << 30, 4_000_000
#: Characters encoded at a time (a longer text alone).
CHARS = 1 << 21
#: Pairs in a row of the table of sums.
PAIRS = 1 << 17
#: Words whose alignment a task remembers.
REMEMBERED = 200_000
#: Where the alignment of a text may be cut: a space alone before a non-space.
ALONE = re.compile(r"(?<=[^ ]) (?=\S)")
OTHER_SPACE = re.compile(r"  | \s| \Z|\A ")
#: Latin letters and at most one mark after them: one or two pre-tokens.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]?\Z")


# --- tokens and their bytes -------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable
    Latin-1 for itself, the rest from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)


def merge_ranks(path: str, token_bytes: list[bytes]):
    """The merges of a tokenizers file for whole strings of plain words: where
    merged tokens are numbered in the order of the merges, the least id is the
    first merge. None for other files."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
    single = {bytes([b]) for b in range(256)}
    if model.get("type") != "BPE" or made != sorted(set(made)) or len(made) + 256 > len(vocab) or single - set(token_bytes):
        return None
    ranks = {token_bytes[i]: i for i in vocab.values() if token_bytes[i] in single} | {token_bytes[i]: i for i in made}
    return tiktoken.Encoding("merges", pat_str=r" ?\p{L}+|[^\s\p{L}]", mergeable_ranks=ranks, special_tokens={})


class Encoders:
    """The two tokenizers and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        alphabet, sp = byte_alphabet(), self.b
        a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
             for i in range(sp.get_piece_size())]
        self.n_a, self.n_b = len(a), len(b)
        self.ranks = merge_ranks(a_path, a)
        spaces = re.compile("[^▁]▁")
        self.by_word = not any(spaces.search(sp.id_to_piece(i)) for i in range(self.n_b)) and sp.normalize(" x  y ") == "▁▁x▁▁y▁"
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a, b)]
        self.sizes = [np.array([len(y) for y in x], np.int64) for x in (a, b)]
        self.digits = pa.array([f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for i in range(n) for end in ends],
                               pa.large_string())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of all texts, one after the other, and their numbers."""
        return [self.encode_a(texts), _flat(self.b.encode(texts, num_threads=1))]

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)])

    def encode_words(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """As `encode`. Plain words go through A's merges in one call, with a
        space between; the bytes tell where a word's tokens end."""
        plain = np.array([bool(PLAIN.match(w)) for w in words], bool) & (self.ranks is not None)
        order = np.argsort(~plain, kind="stable")
        own, parts = [words[k] for k in order[:plain.sum()]], []
        if own:
            ids = self.ranks.encode_to_numpy(" " + " ".join(own)).astype(np.int64)
            ends = np.cumsum([len(w.encode()) + 1 for w in own])
            parts.append((ids, np.diff(np.searchsorted(np.cumsum(self.sizes[0][ids]), ends), prepend=-1)))
        if len(own) < len(words):
            parts.append(self.encode_a([words[k] for k in order[len(own):]]))
        ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        back = np.argsort(order, kind="stable")
        low, n = (np.cumsum(n) - n)[back], n[back]
        return [(ids[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(ids))], n), _flat(self.b.encode(words, num_threads=1))]

    def joined(self, side: int, ids: np.ndarray) -> memoryview:
        taken = self.bytes[side].take(pa.array(ids))
        return memoryview(taken.buffers()[2] or b"").cast("B")

    def whole(self, texts: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which texts both sides give back byte by byte."""
        wanted = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        ok = np.ones(len(texts), bool)
        for side, (ids, n) in enumerate(sides):
            data = self.joined(side, ids)
            ends = np.concatenate([[0], np.cumsum(self.sizes[side][ids])])[np.concatenate([[0], np.cumsum(n)])]
            ok &= [data[low:high] == w for low, high, w in zip(ends[:-1].tolist(), ends[1:].tolist(), wanted, strict=True)]
        return ok


class Aligned:
    """Alignment of texts that both sides give back whole."""

    def __init__(self, enc: Encoders, sides: list[tuple[np.ndarray, np.ndarray]]):
        (self.a, n_a), (self.b, n_b) = sides
        ends_a, ends_b = (np.cumsum(size[x]) for size, x in zip(enc.sizes, (self.a, self.b), strict=True))
        cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs: a merge
        cuts = cuts[np.diff(cuts, prepend=0) > 0]
        self.at_a, self.at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        both = (ends_a[self.at_a] == cuts) & (ends_b[self.at_b] == cuts)
        self.groups = cuts[both]
        self.doc = np.repeat(np.arange(len(n_a)), n_a)[self.at_a]
        self.n_a, self.n_b = n_a, n_b
        self.n_links = np.bincount(self.doc, minlength=len(n_a))
        self.n_groups = np.bincount(self.doc[both], minlength=len(n_a))
        self.ends_a, self.ends_b, self.enc = ends_a, ends_b, enc

    def written(self) -> list[bytes]:
        """The groups of each text, written out."""
        g_a, g_b = np.searchsorted(self.groups, self.ends_a), np.searchsorted(self.groups, self.ends_b)
        to_a, to_b = np.searchsorted(self.ends_a, self.groups, "right"), np.searchsorted(self.ends_b, self.groups, "right")
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + np.concatenate([[0], to_b[:-1]])[g_a]] = 2 * self.a + (self.groups[g_a] == self.ends_a)
        codes[np.arange(len(self.b)) + to_a[g_b]] = 2 * (self.enc.n_a + self.b) + (self.groups[g_b] == self.ends_b)
        taken = self.enc.digits.take(pa.array(codes))
        at, data = np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1), memoryview(taken.buffers()[2])
        ends = at[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [bytes(data[low:high - 1]) for low, high in zip(ends[:-1], ends[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, number of the text, links) of each text's distinct pairs."""
        key = self.a[self.at_a] * self.enc.n_b + self.b[self.at_b]
        width = self.enc.n_a * self.enc.n_b
        own, n = np.unique(self.doc * width + key, return_counts=True)
        return own % width, own // width, n


class Batch:
    """Some texts aligned: which are ``whole``; for these the four counts, the
    hash, and (pair, number of the text, links)."""

    def __init__(self, whole: np.ndarray, counts: np.ndarray, hashes: list[str], pairs: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.whole, self.counts, self.hashes, self.pairs = whole, counts, hashes, pairs


def aligned_texts(enc: Encoders, texts: list[str]) -> Batch:
    sides = enc.encode(texts)
    ok = enc.whole(texts, sides)
    x = Aligned(enc, [(ids[np.repeat(ok, n)], n[ok]) for ids, n in sides])
    return Batch(ok, np.array([x.n_a, x.n_b, x.n_groups, x.n_links]), [hashlib.sha256(w).hexdigest() for w in x.written()], x.pairs())


class Words(dict):
    """word -> its number; alignments of the words by number."""

    def __init__(self, enc: Encoders):
        super().__init__()
        self.enc = enc
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.written: list[bytes] = []
        self.counts = np.zeros((4, 0), np.int64)
        self.ok = np.zeros(0, bool)
        self.ends, self.pair, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        sides = self.enc.encode_words(words)
        ok = self.enc.whole(words, sides)
        x = Aligned(self.enc, [(ids[np.repeat(ok, n)], n[ok]) for ids, n in sides])
        base, at, counts = len(self), np.flatnonzero(ok), np.zeros((4, len(words)), np.int64)
        counts[:, at] = x.n_a, x.n_b, x.n_groups, x.n_links
        written = [b""] * len(words)
        for k, w in zip(at.tolist(), x.written(), strict=True):
            written[k] = w
        pair, word, links = x.pairs()
        n = np.bincount(at[word], minlength=len(words))
        self.update(zip(words, range(base, base + len(words)), strict=True))
        self.written += written
        self.counts, self.ok = np.concatenate([self.counts, counts], 1), np.concatenate([self.ok, ok])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        self.pair, self.links = np.concatenate([self.pair, pair]), np.concatenate([self.links, links])

    def align(self, texts: list[str]) -> Batch:
        split = [ALONE.split(t) if OTHER_SPACE.search(t) else t.split(" ") for t in texts]
        new = set().union(*split).difference(self)
        if len(self) + len(new) > REMEMBERED:
            self.forget()
            new = set().union(*split)
        if new:
            self.learn(list(new))
        get = self.__getitem__
        own = np.fromiter(chain.from_iterable(map(get, w) for w in split), np.int64)
        n = np.array([len(w) for w in split], np.int64)
        start = np.cumsum(n) - n
        whole = np.logical_and.reduceat(self.ok[own], start)
        counts = np.add.reduceat(self.counts[:, own], start, 1)[:, whole]
        ends, at = (start + n).tolist(), own.tolist()
        written = self.written
        hashes = [hashlib.sha256(b";".join([written[w] for w in at[low:high]])).hexdigest()
                  for low, high, good in zip(start.tolist(), ends, whole.tolist(), strict=True) if good]
        doc = np.repeat(np.cumsum(whole) - 1, n)
        word, doc = own[np.repeat(whole, n)], doc[np.repeat(whole, n)]
        words, times = np.unique(doc * len(self) + word, return_counts=True)
        doc, word = words // len(self), words % len(self)
        low, size = self.ends[word], self.ends[word + 1] - self.ends[word]
        take = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        width = self.enc.n_a * self.enc.n_b
        key, links = np.repeat(doc, size) * width + self.pair[take], np.repeat(times, size) * self.links[take]
        order = np.argsort(key, kind="stable")
        key, links = key[order], links[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        pairs = (key[first] % width, key[first] // width, np.add.reduceat(links, first) if len(first) else links)
        return Batch(whole, counts, hashes, pairs)


# --- runs -------------------------------------------------------------------

_RUN, _BLOCK = struct.Struct("<qII"), struct.Struct("<II")


def _planes(x: np.ndarray) -> bytes:
    """Little-endian bytes, all first bytes first."""
    return np.ascontiguousarray(x.view("u1").reshape(len(x), -1).T).tobytes()


def _unplaned(data: memoryview, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(-1, n).T).view(kind).reshape(-1)


def write_run(base: int, key: np.ndarray, doc: np.ndarray, links: np.ndarray) -> bytes:
    """Sorted records as blocks: first row id and how many follow it, then size
    and content of each block."""
    press, out = zstandard.ZstdCompressor(level=1), []
    for i in range(0, len(key), RUN_BLOCK):
        k = key[i:i + RUN_BLOCK].astype("<u8")
        steps = np.diff(k, prepend=np.uint64(0))
        body = press.compress(_planes(steps) + _planes(doc[i:i + RUN_BLOCK].astype("<u4")) + _planes(links[i:i + RUN_BLOCK].astype("<u4")))
        out.append(_BLOCK.pack(len(body), len(k)) + body)
    return _RUN.pack(base, int(doc.max()) + 1, len(out)) + b"".join(out)


def read_run(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, unpress = memoryview(blob), zstandard.ZstdDecompressor()
    (_, _, blocks), at = _RUN.unpack_from(data), _RUN.size
    for _ in range(blocks):
        size, n = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        body = memoryview(unpress.decompress(data[at:at + size], max_output_size=16 * n))
        at += size
        yield (np.cumsum(_unplaned(body[:8 * n], "<u8", n)).astype(np.int64), _unplaned(body[8 * n:12 * n], "<u4", n).astype(np.int64),
               _unplaned(body[12 * n:], "<u4", n).astype(np.int64))


def run_rows(blob: bytes) -> tuple[int, int]:
    """First row id of a run and how many row ids it spans."""
    return _RUN.unpack_from(blob)[:2]


def merged(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """k-way merge of runs: pieces (pair, run, number in the run, links), pairs
    ascending over all. The heap has the last pair of each loaded block; up to
    the least of them, nothing can be missing."""
    readers = [read_run(b) for b in blobs]
    loaded, heap = {}, []

    def load(r: int) -> None:
        block = next(readers[r], None)
        loaded.pop(r, None)
        if block is not None:
            loaded[r] = block
            heapq.heappush(heap, (int(block[0][-1]), r))

    for r in range(len(readers)):
        load(r)
    while heap:
        bound, parts = heap[0][0], []
        for r, (key, doc, links) in list(loaded.items()):
            n = int(np.searchsorted(key, bound, "right"))
            if n:
                parts.append((key[:n], np.full(n, r), doc[:n], links[:n]))
                loaded[r] = (key[n:], doc[n:], links[n:])
        ended = []
        while heap and heap[0][0] == bound:
            ended.append(heapq.heappop(heap)[1])
        for r in ended:
            load(r)
        key, run, doc, links = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        yield key[order], run[order], doc[order], links[order]


class Spills:
    """Records of a task; gives runs by radix when there are enough."""

    def __init__(self, n_b: int):
        self.n_b, self.held, self.n, self.base, self.next = n_b, [], 0, 0, 0

    def add(self, key: np.ndarray, doc: np.ndarray, links: np.ndarray, rows: np.ndarray) -> None:
        """``doc`` numbers ``rows``, the row ids, which ascend."""
        if not self.held and len(rows):
            self.base = int(rows[0])
        self.held.append((key, rows[doc] - self.base, links))
        self.n += len(key)

    def runs(self) -> Iterator[tuple[int, bytes]]:
        if self.n:
            key, doc, links = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.argsort(key, kind="stable")
            key, doc, links = key[order], doc[order], links[order]
            radix = key // self.n_b % RADIX
            for r in range(RADIX):
                own = radix == r
                if own.any():
                    yield r, write_run(self.base, key[own], doc[own], links[own])
        self.held, self.n = [], 0


# --- tasks ------------------------------------------------------------------

_ENCODERS: dict[tuple[str, str], Words] = {}
_ALIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                      ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("radix", pa.int32()), ("portion", pa.int64()), ("run", pa.binary())])
ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "radix int, portion long, run binary")


def _portions(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    keys, own, held = [], [], 0
    for k, t in zip(ids, texts, strict=True):
        keys.append(k.as_py())
        own.append(t.as_py() or "")
        held += len(own[-1])
        if held >= CHARS:
            yield keys, own
            keys, own, held = [], [], 0
    if keys:
        yield keys, own


def _aligner(a_path: str, b_path: str, tasks_a_portion: int):
    """Rows of documents -> their alignment (run null), and runs (row null)."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _ENCODERS:
            _ENCODERS[a_path, b_path] = Words(Encoders(a_path, b_path))
        words, task = _ENCODERS[a_path, b_path], TaskContext.get().partitionId()
        enc = words.enc
        portion, row, spills = task // tasks_a_portion, task << 33, Spills(enc.n_b)

        def written() -> Iterator[pa.RecordBatch]:
            for r, blob in spills.runs():
                yield pa.RecordBatch.from_pylist([{"radix": r, "portion": portion, "run": blob}], schema=_ALIGNED)

        for batch in batches:
            for keys, texts in _portions(batch.column("doc_id"), batch.column("text")):
                n = len(keys)
                out = np.zeros((4, n), np.int64)
                hashes, some = [""] * n, np.flatnonzero([bool(t) for t in texts])
                if len(some):
                    own = [texts[k] for k in some]
                    x = words.align(own) if enc.by_word else aligned_texts(enc, own)
                    some = some[x.whole]
                    out[:, some] = x.counts
                    for k, h in zip(some.tolist(), x.hashes, strict=True):
                        hashes[k] = h
                    if len(some):
                        spills.add(*x.pairs, row + some)
                none = pa.nulls(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), pa.array(keys, pa.int64()), *[pa.array(x) for x in out], pa.array(hashes, pa.string()),
                     none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary())], schema=_ALIGNED)
                row += n
                if spills.n >= SPILL:
                    yield from written()
        yield from written()
    return align


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """Rows of a sorted partition that agree in ``names``."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and any(held[0][c] != r[c] for c in names):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _counter(n_b: int):
    """All runs of a radix and portion -> documents of each pair."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["radix", "portion"]):
            carried, more = -1, 0
            for key, _, _, _ in merged([r["run"] for r in rows]):
                own, n = np.unique(key, return_counts=True)
                if own[0] == carried:
                    n[0] += more
                elif more:
                    own, n = np.concatenate([[carried], own]), np.concatenate([[more], n])
                carried, more = int(own[-1]), int(n[-1])
                own, n = own[:-1], n[:-1]
                if len(own):
                    yield _pairs(own, n)
            if more:
                yield _pairs(np.array([carried]), np.array([more]))

    def _pairs(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key // n_b), pa.array(key % n_b), pa.array(n)], ["a", "b", "n"])
    return count


def _ranker(n_b: int):
    """Sums sorted by A and B id -> (radix, portions of pairs with their count
    and whether it is the highest of the A id). Holds the pairs of a portion
    and of one A id, so never more than PAIRS and the vocabulary of B."""
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in chain(batches, [None]):
            new = [batch.column(c).to_numpy() for c in ("a", "b", "n")] if batch is not None else None
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if new else held
            a, b, n = held
            if not len(a) or new and len(a) < PAIRS:
                continue
            turns = np.flatnonzero(np.diff(a)) + 1
            whole = (int(turns[-1]) if len(turns) else 0) if new else len(a)
            if not whole:
                continue
            starts = np.concatenate([[0], turns[turns < whole]]).astype(np.int64)
            most = np.repeat(np.maximum.reduceat(n[:whole], starts), np.diff(np.append(starts, whole)))
            best = (n[:whole] == most).astype("u1")
            radix = a[:whole] % RADIX
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(radix)) + 1, [whole]])
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = (a[low:high] * n_b + b[low:high]).astype("<i8").tobytes()
                blob = zstandard.ZstdCompressor(level=1).compress(key + n[low:high].astype("<i8").tobytes() + best[low:high].tobytes())
                yield pa.RecordBatch.from_pylist([{"radix": int(radix[low]), "size": high - low, "run": blob}],
                                                 schema=pa.schema([("radix", pa.int32()), ("size", pa.int64()), ("run", pa.binary())]))
            held = [x[whole:] for x in held]
    return rank


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a radix (size set), then the runs of a radix and portion ->
    what its pairs add to each document."""
    for rows in _groups(batches, ["radix", "portion"]):
        keys, counts, bests = [], [], []
        for r in rows:
            if r["size"]:
                data = zstandard.ZstdDecompressor().decompress(r["run"])
                n = r["size"]
                keys.append(np.frombuffer(data, "<i8", n))
                counts.append(np.frombuffer(data, "<i8", n, 8 * n))
                bests.append(np.frombuffer(data, "u1", n, 16 * n))
        key, count, best = np.concatenate(keys), np.concatenate(counts), np.concatenate(bests).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, count, best = key[order], count[order], best[order]
        runs = [r["run"] for r in rows if not r["size"]]
        base, span = (np.array(x, np.int64) for x in zip(*map(run_rows, runs), strict=True))
        start = np.concatenate([[0], np.cumsum(span)])
        sums = np.zeros((2, start[-1]), np.int64)
        for pair, run, doc, links in merged(runs):
            at, to = np.searchsorted(key, pair), start[run] + doc
            np.add.at(sums[0], to, links * best[at])
            np.add.at(sums[1], to, links * count[at])
        own = np.flatnonzero(sums[1])
        run = np.searchsorted(start, own, "right") - 1
        for i in range(0, len(own), 50_000):
            o, r = own[i:i + 50_000], run[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(base[r] + o - start[r]), pa.array(sums[0][o]), pa.array(sums[1][o])],
                                             ["row", "n_best", "count_sum"])


# --- Spark ------------------------------------------------------------------

def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256 for each row. ``a_path``: a tokenizers file,
    ``b_path``: a sentencepiece model, which every executor has."""
    spark, out = docs.sparkSession, scratch(docs.sparkSession, "aligned")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = docs.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("docs"))
    most = tasks.agg(F.max("bytes"), F.max("docs")).first()
    together = max(1, min(PORTION_BYTES // max(1, most[0] or 0), PORTION_DOCS // max(1, most[1] or 0)))
    docs.mapInArrow(_aligner(a_path, b_path, together), ALIGNED).write.parquet(out)
    written = spark.read.schema(ALIGNED).parquet(out)
    runs = written.where("run is not null").select("radix", "portion", "run")
    n_b = pieces(b_path)
    where = ["radix", "portion"]
    counted = runs.repartition(*where).sortWithinPartitions(*where).mapInArrow(_counter(n_b), "a long, b long, n long")
    total = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).withColumn("radix", (F.col("a") % RADIX).cast("int"))
    ranked = cut(total.repartition("radix").sortWithinPartitions("radix", "a", "b").mapInArrow(_ranker(n_b), "radix int, size long, run binary"))
    side = ranked.join(runs.select(*where).distinct(), "radix").select(*where, "size", "run")
    both = side.unionByName(runs.withColumn("size", F.lit(0).cast("long")))
    added = (both.repartition(*where).sortWithinPartitions(*where).mapInArrow(_contributions, "row long, n_best long, count_sum long")
             .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    own = written.where("run is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return own.join(added, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def pieces(path: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
