"""The pipeline's rows, stage by stage, against plain Python on each stage's
own input (language identification and the draws of the mix as given)."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from vintage.llm import queries, token_counts
from vintage.llm.common import ship, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that went into and came out of each stage of run()."""
    ship(spark)
    rng, at = random.Random(4), str(tmp_path_factory.mktemp("tables"))
    base = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    rows = [tuple(r) for r in base[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)][:90]
    items = [" ".join(f"item{i}word{k}" for k in range(30)) + "." for i in range(4)]
    english = [r for r in rows if r[2] == "en" and len(words(r[1])) > 60][:12]
    for k, r in enumerate(english):
        own = r[1].split(" ")
        if k % 3 == 0:  # a near copy: one word of many changed
            own[rng.randrange(len(own))] = "changed"
        if k % 3 == 1:  # an item of the benchmark inside
            own[5:5] = items[k % 4].split(" ")
        rows.append((10_000 + k, " ".join(own), r[2], r[3], r[4]))
    rows = [(d, t, la, s, None if n is None or n != n else int(n)) for d, t, la, s, n in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    seen, own = [], []
    for name, stage in corpus_pipeline.STAGES:
        def kept(spark, docs, sf_dir, stage=stage):
            seen.append([tuple(r) for r in docs.collect()])
            return stage(spark, docs, sf_dir)
        own.append((name, kept))
    before = corpus_pipeline.STAGES
    corpus_pipeline.STAGES = own
    try:
        out = [tuple(r) for r in corpus_pipeline.run(spark, at).collect()]
    finally:
        corpus_pipeline.STAGES = before
    return [*seen, out], items


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_language_only_drops_rows(stages):
    (first, second, *_), _ = stages
    assert set(second) <= set(first) and len(second) > 0.8 * len(first)


def test_near_duplicates(stages):
    (_, before, after, *_), _ = stages
    sets, up = [shingles(r[1]) for r in before], list(range(len(before)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if before[i][1] == before[j][1] or a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, r in enumerate(before):
        groups[top(i)].append(r[0])
    assert sorted(r[0] for r in after) == sorted(min(g) for g in groups.values())
    assert set(after) <= set(before) and len(after) < len(before)


def test_decontamination(stages):
    (_, _, before, after, *_), items = stages
    copies = {r[0] for r in before if any(" ".join(words(x)) in " ".join(words(r[1])) for x in items)}
    assert copies and sorted(after) == sorted(r for r in before if r[0] not in copies)


def test_mix_gives_runs_of_words(stages):
    (_, _, _, before, after, _), _ = stages
    own, taken, sizes = defaultdict(list), Counter(), Counter()
    for r in before:
        own[r[0]].append(r[1].split())
        sizes[r[3]] += len(r[1].split())
    for d, text, _, source, _ in after:
        run = text.split()
        assert any(run == w[i:i + len(run)] for w in own[d] for i in range(len(w)) if w[i] == run[0]), d
        taken[source] += len(run)
    assert set(taken) <= set(sizes) and all(n <= 3.2 * sizes[s] + 64 for s, n in taken.items())


def test_tokens(stages):
    (*_, before, after), _ = stages
    tokenizer = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    rows = [(r[0], (*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in before]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r[0], r[2], r[3]) for r in after) == Counter((d, len(ids), crc(ids)) for d, ids in rows)
    start = 0
    for d, at, n, _ in sorted(after, key=lambda r: r[1]):
        assert at == start
        start += n
    in_order = [r[0] for r in sorted(after, key=lambda r: r[1])]
    assert in_order == sorted(in_order)


def test_token_counts_of_the_query(spark):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    pieces = set(token_counts.vocabulary(path))
    longest = max(map(len, pieces))

    def greedy(word):
        n, i = 0, 0
        while i < len(word):
            step = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i:i + k] in pieces), 0)
            n += 1 if step else len(word[i].encode("utf-8", "surrogatepass"))
            i += max(step, 1)
        return n

    rows = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    want = {(r.doc_id, len(w := (r.text or "").split()), sum(greedy(token_counts.MARKER + x) for x in w)) for r in rows.itertuples()}
    assert {tuple(r) for r in queries.op7_token_counts(spark, SF).collect()} == want
