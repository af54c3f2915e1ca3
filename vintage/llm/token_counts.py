"""Token counts (operator 7): a linear longest-match automaton.

A word, with the marker that begins words in front, is cut greedily: at each
place the longest vocabulary piece is taken. The automaton (Song et al. 2021)
is a trie of the vocabulary in which a failure link leads from the node of a
string to the node of what is left after the longest matches inside it, and
carries the number of pieces taken on the way. So a word is read once, without
backtracking, and its pieces are counted but never built. A character that no
piece covers counts as its UTF-8 bytes (byte fallback).

Words are what white space separates. Null and empty texts count 0 pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose counts a worker remembers.
REMEMBERED = 300_000
MARKER = "▁"


class Automaton:
    """Vocabulary trie with failure links and popped-piece counts."""

    def __init__(self, pieces: list[str]):
        chars = {c for p in pieces for c in p}
        self.next: list[dict[str, int]] = [{}]
        own: list[int] = [0]  # pieces that the node's string is by itself; 0: none
        for piece, n in [*((c, len(c.encode())) for c in chars), *((p, 1) for p in pieces if p)]:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    own.append(0)
                node = self.next[node][c]
            own[node] = n
        self.fail, self.popped = [0] * len(own), [0] * len(own)
        queue = [0]
        for u in queue:  # breadth first
            for c, v in self.next[u].items():
                queue.append(v)
                if own[v]:
                    self.fail[v], self.popped[v] = 0, own[v]
                else:  # every character is a piece, so a root's child always is
                    z, n = self.fail[u], self.popped[u]
                    while c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def count(self, word: str) -> int:
        """Pieces that greedy longest match makes of ``word``."""
        nxt, fail, popped, u, n = self.next, self.fail, self.popped, 0, 0
        for c in word:
            while c not in nxt[u]:
                if not u:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += popped[u]
                u = fail[u]
            else:
                u = nxt[u][c]
        while u:
            n += popped[u]
            u = fail[u]
        return n


class WordCounts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.automaton.count(MARKER + word)
        return n


_COUNTS: dict[str, WordCounts] = {}


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_pieces for each row of ``docs`` (doc_id, text);
    ``model``: a sentencepiece model file that every executor has."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _COUNTS:
            _COUNTS[model] = WordCounts(Automaton(vocabulary(model)))
        counts = _COUNTS[model]
        for batch in batches:
            n_words, n_pieces = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                n_words.append(len(words))
                n_pieces.append(sum([counts[w] for w in words]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())],
                ["doc_id", "n_words", "n_pieces"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_pieces long")
