"""Cross-tokenizer alignment against plain loops over all documents."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vintage.llm import token_alignment as ta
from vintage.llm.common import ship
from vintage.llm.queries import tokenizer_file

FIELDS = "doc_id long, text string"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def plain(rows):
    from tokenizers import decoders
    a, b, decode = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), decoders.ByteLevel()
    a.encode_special_tokens = True
    alphabet = {}
    for i, c in ((a.token_to_id(t), t) for t in a.get_vocab() if len(t) == 1):
        alphabet[c] = i
    by_char = ta.byte_alphabet()
    assert set(alphabet) == set(by_char) and all(decode.decode([c]).encode() == bytes([by_char[c]]) for c in by_char if by_char[c] < 128)
    docs, held = [], Counter()
    for doc_id, text in rows:
        row, links = [doc_id, 0, 0, 0, 0, ""], []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(by_char[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                spans = []
                for tokens in (ba, bb):
                    at, own = 0, []
                    for t in tokens:
                        own.append((at, at + len(t)))
                        at += len(t)
                    spans.append(own)
                i = j = 0
                while i < len(ia) and j < len(ib):  # the overlaps, in order
                    (la, ha), (lb, hb) = spans[0][i], spans[1][j]
                    if max(la, lb) < min(ha, hb):
                        links.append((ia[i], ib[j]))
                    i, j = i + (ha <= hb), j + (hb <= ha)
                groups, ga, gb, ea, eb = [], [], [], {h for _, h in spans[0]}, {h for _, h in spans[1]}
                for end in sorted(ea & eb):
                    ga = [str(x) for x, (_, h) in zip(ia, spans[0], strict=True) if (groups and groups[-1][0] or 0) < h <= end]
                    gb = [str(x) for x, (_, h) in zip(ib, spans[1], strict=True) if (groups and groups[-1][0] or 0) < h <= end]
                    groups.append((end, f"{','.join(ga)}|{','.join(gb)}"))
                row = [doc_id, len(ia), len(ib), len(groups), len(links), hashlib.sha256(";".join(g for _, g in groups).encode()).hexdigest()]
        held.update(set(links))
        docs.append((row, links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [(*r[:5], sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), r[5]) for r, links in docs]


def key(r):
    return tuple((x is None, x or 0) for x in r[:1] + r[1:7])


def compare(spark, df):
    ship(spark)
    got = sorted((tuple(r) for r in ta.align(df, A, B).collect()), key=key)
    assert got == sorted(plain([tuple(r) for r in df.select("doc_id", "text").collect()]), key=key)
    return got


def test_documents_with_many_small_runs(spark, monkeypatch):
    monkeypatch.setattr(ta, "SPILL", 500)
    monkeypatch.setattr(ta, "CHARS", 3_000)
    monkeypatch.setattr(ta, "RUN_BLOCK", 64)
    monkeypatch.setattr(ta, "PORTION_DOCS", 30)
    monkeypatch.setattr(ta, "PAIRS", 100)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 1500).alias("text"))
    got = compare(spark, docs.limit(80).repartition(6))
    assert sum(r[5] for r in got) > 0


def test_words_equal_whole_texts(spark):
    import pyarrow.parquet as pq
    import random
    rng = random.Random(1)
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    parts = ["a", "Word", "don't", " ", "  ", "\n", "\t ", "\u00a0", "\u2028", "\x85", "\x1c", "12", "é", "日本", "😀", "<s>", "<|endoftext|>", "▁", ".", "'s"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts += [f"{x}{chr(c)}{y}" for c in range(1, 0x3100, 3) if not 0xD800 <= c < 0xE000 for x, y in (("a ", "b"), ("a", " b"))]
    enc = ta.Encoders(A, B)
    assert enc.by_word
    words = ta.Words(enc)
    for i in range(0, len(texts), 1500):
        own = texts[i:i + 1500]
        one, other = ta.aligned_texts(enc, own), words.align(own)
        assert np.array_equal(one.whole, other.whole) and np.array_equal(one.counts, other.counts) and one.hashes == other.hashes
        assert all(np.array_equal(x, y) for x, y in zip(one.pairs, other.pairs, strict=True))


def test_forgetting_words(monkeypatch):
    monkeypatch.setattr(ta, "REMEMBERED", 5)
    words = ta.Words(ta.Encoders(A, B))
    for text in ("one two three four", "five six seven", "one five", "a b c d e f g h"):
        got, want = words.align([text, "x"]), ta.aligned_texts(words.enc, [text, "x"])
        assert got.hashes == want.hashes and np.array_equal(got.counts, want.counts)


def test_merge_of_runs():
    rng = np.random.default_rng(1)
    for block in (3, 1 << 14):
        ta.RUN_BLOCK, before = block, ta.RUN_BLOCK
        records, blobs = [], []
        for r in range(9):
            n = int(rng.integers(1, 400))
            k = np.sort(rng.choice([5, 5, 7, 1 << 33, *range(20, 60)], n))
            d, m = rng.integers(0, 50, n), rng.integers(1, 9, n)
            blobs.append(ta.write_run(r << 33, k, d, m))
            assert ta.run_rows(blobs[-1]) == (r << 33, d.max() + 1)
            records += zip(k.tolist(), [r] * n, d.tolist(), m.tolist(), strict=True)
        got = [np.concatenate(x) for x in zip(*ta.merged(blobs), strict=True)]
        assert (np.diff(got[0]) >= 0).all()
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(records)
        ta.RUN_BLOCK = before


ROWS = [(1, "a repeated row, <|endoftext|> and <s> </s> <0x41> as text"), (1, "a repeated row, <|endoftext|> and <s> </s> <0x41> as text"), (2, None), (3, ""),
        (None, "nobody's text"), (4, " "), (5, "  two  spaces \n\n\ttabs\r\n"), (6, "a▁b is no space"), (7, "日本語 und 😀👩‍👩‍👧 ÄÖ é"), (8, "long text here, 12345 " * 20_000),
        (9, "\x00\x01 control"), (10, "é ﬁ ² ½ Å nbsp　wide"), (11, "ABC" * 300), (-1, "x")]


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
def test_edges(spark, kind):
    df = spark.createDataFrame([] if kind == "empty" else ROWS[:9] + ROWS[10:], FIELDS) if kind != "rows" else spark.createDataFrame(
        [r for r in ROWS if r[0] != 8] + [(8, ROWS[9][1][:5_000])], FIELDS)
    if kind == "clashes":
        df = df.select("*", *[F.lit("x").alias(c) for c in ("row", "task", "radix", "portion", "run", "size", "a", "b", "n", "n_a", "bytes", "docs")])
    got = compare(spark, df)
    assert len(got) == (0 if kind == "empty" else len(ROWS) - (kind == "clashes"))
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in got if r[0] in (2, 3, 6))


def test_very_long_text(spark):
    ship(spark)
    text = ROWS[9][1]
    r = ta.align(spark.createDataFrame([(8, text)], FIELDS), A, B).first()
    a, b = ta.Encoders(A, B).encode([text])
    assert (r.n_a, r.n_b) == (len(a[0]), len(b[0])) and r.n_links == r.n_a + r.n_b - r.n_groups
