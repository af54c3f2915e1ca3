"""The operators against brute force, round trips and held-out labels."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vintage.llm import (decontaminate, fingerprint, langid, mixing, ngram_join, permute, queries, sharding, token_counts,
                         token_output, toxicity, warc)
from vintage.llm.common import scratch, ship, words

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def local():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    sets = [shingle_set(t) for t in texts]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if texts[i] == texts[j] or a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    return links


def test_permutation_is_one_to_one_and_has_an_integer_twin(spark):
    for n in (1, 2, 3, 7, 99, 1025, 3000):
        rows = spark.range(n).select("id", permute.permute(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))
        assert all(permute.permute_int(r.id, n, 5) == r.p for r in rows[:100])


def test_walks_that_are_not_done_are_errors(spark, monkeypatch):
    monkeypatch.setattr(permute, "SMALL", 0)
    monkeypatch.setattr(permute, "MANY", 1)
    df = spark.range(200).select(permute.permute(F.col("id"), F.lit(200).cast("long"), F.lit(5).cast("long")).alias("p"))
    with pytest.raises(Exception, match="cycle walk"):
        df.collect()
    null = spark.range(1).select(permute.permute(F.lit(None).cast("long"), F.lit(200).cast("long"), F.lit(5).cast("long")).alias("p"))
    assert null.first().p is None


def test_shards_differ_by_one_row_and_can_be_computed(docs):
    got = sharding.assign_shards(docs, 7).toPandas()
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and len(n) == 7
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    assert all(sharding.place(r.row_number, len(got), 7) == (r.shard, r.slot) for r in got.itertuples())
    assert got.equals(got) and sharding.assign_shards(docs.repartition(5), 7).toPandas().sort_values("doc_id")["shard"].tolist() == \
        got.sort_values("doc_id")["shard"].tolist()


def test_token_files_round_trip(spark, docs, local):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    tokenizer, start = token_output.load_tokenizer(path), 0
    out = scratch(spark, "ids")
    token_output.write_token_files(docs, out, path, shard_bytes=100_000)
    got = token_output.read_token_files(spark, out, 2).toPandas().set_index("doc_id")
    assert len(got) == len(local)
    for d, t in zip(local.doc_id, local.text):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        r = got.loc[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    asked = spark.createDataFrame([(3,), (17,), (10**9,), (None,)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_output.lookup(spark, out, asked, 2).collect()}
    assert set(found) == {3, 17}
    assert found[3] == [*tokenizer.encode(local.text[local.doc_id == 3].iloc[0], add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", [
    "it's we'll don't 'tis", "a  b   c\n\n d \t e\n", "  lead trail  ", "x<|endoftext|>y <|endoftext|> z",
    "12a a12 3.14 foo.. bar!? ½ ² 漢字。 😀 a b", "", "\n", " ", ". , a. b, c'", " a\r\n b\x0b c \x85 d"])
def test_pieces_equal_whole_text_encoding(text):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    pieces = token_output.Pieces(path, 2)
    want = np.array(token_output.load_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert pieces.encode([text, "other", text]) [::2] == [want, want]


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.arange(-3000, 9000, 3, dtype="<i8").view("<u8")
    mph = token_output.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    prints = np.zeros(len(keys), "<u4")
    prints[mph.slots(keys)] = token_output.fingerprints(keys)
    strangers = np.arange(100_000, 200_000, dtype="<u8")
    slot = mph.slots(strangers)
    assert not ((slot >= 0) & (prints[slot] == token_output.fingerprints(strangers))).any()


def test_piece_counts_equal_greedy_matching(local):
    pieces = token_counts.vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))
    own, longest, automaton = set(pieces), max(map(len, pieces)), token_counts.Automaton(pieces)

    def greedy(w):
        i = n = 0
        while i < len(w):
            j = next((j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in own), None)
            n, i = (n + 1, j) if j else (n + len(w[i].encode()), i + 1)
        return n

    for t in [*local.text[:60], "漢字 テスト 😀x ▁▁ a▁b ﷺ ퟿"]:
        for w in t.split():
            assert automaton.count("▁" + w) == greedy("▁" + w)


def test_fingerprints_of_edited_texts(docs, local):
    got = fingerprint.fingerprints(docs.repartition(4)).toPandas().set_index("doc_id")
    texts, ids = list(local.text[::-1]), list(local.doc_id[::-1])
    for k, (d, t) in enumerate(zip(ids, texts)):
        n, nxt = len(t), texts[(k + 1) % len(texts)]
        edited, r = t[:n - n // 2] + nxt[:n // 2], got.loc[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint.fingerprint(t) and r.edited_fingerprint == fingerprint.fingerprint(edited)
    assert got.near_edited.mean() > got.near_next.mean() + 0.3


def test_fingerprint_is_a_multiset_hash():
    f, total = fingerprint.fingerprint, fingerprint.sum_of
    assert f("a b\nc d\ne") == f("e\na b\nc d") != f("a b\nc d")
    assert f("x\nx") != f("x")
    assert str(fingerprint.Sum.parse(f("a b\nc d\ne")) - total(["c d"]) + total(["q r"])) == f("a b\nq r\ne")
    long = "w v " * 50_000
    assert f(long) == f(long) and f(None) == f("")


def test_unrelated_long_texts_are_not_alike():
    for n in (65_536, 200_000):
        a, b = ([" ".join(f"{c}{i}" for i in range(n + 1))] for c in "xy")
        a, b = fingerprint.sum_of(a), fingerprint.sum_of(b)
        assert fingerprint.likeness(a, b) < 0.3


def test_near_duplicates_against_brute_force(docs, local):
    got = ngram_join.near_duplicates(docs).toPandas().set_index("doc_id")
    links = brute_links(list(local.text))
    up = list(range(len(local)))
    changed = True
    while changed:
        changed = False
        for i in links:
            low = min(up[j] for j in [i, *links[i]])
            if low < up[i]:
                up[i], changed = low, True
    for i, d in enumerate(local.doc_id):
        assert got.n_links[d] == len(links[i]) and got.class_id[d] == local.doc_id[up[i]]
    kept = ngram_join.one_of_each(docs).toPandas()
    assert sorted(kept.doc_id) == sorted(set(local.doc_id[up])) and list(kept.columns) == list(docs.columns)


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1:]) for k in range(60)] + ["lone text of a few words"]
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    links = brute_links(texts)
    assert all(got.n_links[i] == len(links[i]) for i in range(61)) and set(got.class_id[:60]) == {0} and got.class_id[60] == 60


def test_pruning_bound_is_the_posterior():
    from math import comb
    for n, m in zip(ngram_join.STEPS, ngram_join.least_matches(), strict=True):
        grid = (np.arange(20_000) + 0.5) / 20_000
        tail = lambda k: float(((like := grid ** k * (1 - grid) ** (n - k)) * (grid >= 0.8)).sum() / like.sum())  # noqa: B023,E731
        assert tail(m) >= ngram_join.TOLERANCE * 0.9 and (m == 0 or tail(m - 1) < ngram_join.TOLERANCE * 1.1)
        assert comb(n, m) > 0


def test_leaks_and_paraphrases(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [" ".join(word() for _ in range(n)) + ". " + " ".join(word() for _ in range(5)) for n in (6, 20, 35, 90)]
    texts = [" ".join(word() for _ in range(300)) for _ in range(40)]
    for k, item in enumerate(items):
        own = item.split()
        texts[k] = " ".join([*texts[k].split()[:100 + k], *own, *texts[k].split()[100:]])
        texts[10 + k] = " ".join([*texts[10 + k].split()[:50], *[w if i % 4 or i > len(own) - 6 else "zz" for i, w in enumerate(own)]])
        texts[20 + k] = " ".join([*texts[20 + k].split()[:50], *own[:len(own) // 3]])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(k, k) for k in range(4)} | {(10 + k, k) for k in range(4)}
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()}
    assert kept == set(range(40)) - {0, 1, 2, 3, 10, 11, 12, 13}


def test_lcs():
    def plain(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(1, 6, rng.integers(1, 90)), rng.integers(1, 6, rng.integers(0, 90))
        assert decontaminate.lcs(a.tolist(), b) == plain(a, b)


def test_mix_keeps_to_targets(docs, local):
    got = mixing.mix(docs, block=16, shard=64).toPandas()
    size = {d: len([w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in t).split(" ") if w])
            for d, t in zip(local.doc_id, local.text)}
    assert {r.doc_id: r.size for r in got.itertuples()} == size
    assert (got.taken <= 3 * got["size"]).all()
    got = got.merge(local[["doc_id", "source"]])
    z = got.groupby("source")["size"].sum()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(z.index))}
    full: set[str] = set()
    while True:
        share = (z.sum() - sum(3 * z[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        new = {s for s in z.index if s not in full and weight[s] * share > 3 * z[s]}
        if not new:
            break
        full |= new
    for s, own in got.groupby("source"):
        want = 3 * z[s] if s in full else weight[s] * share
        assert own.target.iloc[0] == pytest.approx(want) and own.source_size.iloc[0] == z[s]
        assert abs(own.taken.sum() - want) <= 40
    again = mixing.mix(docs.repartition(3), block=16, shard=64).toPandas()
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())
    texts = mixing.mixed_texts(docs, block=16, shard=64).toPandas()
    n = Counter()
    for r in texts.itertuples():
        n[r.doc_id] += mixing_words(r.text)
    assert all(n[r.doc_id] == r.taken for r in got.itertuples())


def spark_hash(*parts):
    """xxhash64 of Spark: 4 bytes (int), 8 bytes (long) or text, one after the other."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, h)
    return h - (h >> 63 << 64)


def plain_mix(rows, block):
    """(doc_id, text) of the mix of ``rows`` (doc_id, text, source): drawn
    blocks of a round that adjoin stay one text of a document."""
    import re
    out, own = [], defaultdict(list)
    for d, t, s in sorted(rows, key=lambda r: (r[0], spark_hash(r[1].encode()))):
        own[s] += [(d, w) for w in re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)]
    names = sorted(own)
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        share = (sum(map(len, own.values())) - sum(3 * len(own[s]) for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        new = {s for s in names if s not in full and weight[s] * share > 3 * len(own[s])}
        if not new:
            break
        full |= new
    for nr, s in enumerate(names):
        n = -(-len(own[s]) // block)
        target = 3 * len(own[s]) if s in full else weight[s] * share
        drawn = defaultdict(set)
        for t in range(min(3 * n, int(target / len(own[s]) * n + 0.5))):
            key = spark_hash((4).to_bytes(4, "little"), nr.to_bytes(4, "little"), (t // n).to_bytes(8, "little")) % permute.PRIME
            drawn[t // n].add(permute.permute_int(t % n, n, key))
        for blocks in drawn.values():
            last = None
            for at, (d, w) in enumerate(own[s]):
                if at // block in blocks:
                    if last != (d, at - 1):
                        out.append((d, ""))
                    out[-1] = (d, out[-1][1] + w)
                    last = (d, at)
    return out


def test_drawn_blocks_that_adjoin_stay_one_text(spark, docs, local):
    for block, df in ((16, mixing.joined_texts(docs, block=16, shard=64)), (64, corpus_pipeline.mix(spark, docs, SF))):
        got = df.toPandas()
        want = plain_mix(list(zip(local.doc_id, local.text, local.source)), block)
        assert Counter(zip(got.doc_id, got.text)) == Counter(want)
        assert (got.n_chars == got.text.str.len()).all()
    whole = {(d, t.lstrip(" \t\n\r\x0b\x0c")) for d, t in zip(local.doc_id, local.text) if mixing_words(t) > 2 * 64}
    assert whole & set(zip(got.doc_id, got.text))


def mixing_words(text):
    import re
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


@pytest.mark.parametrize("split", ["64m", "1500"])
def test_archive_round_trip_with_version_lines_in_payloads(spark, split):
    ship(spark)
    trap = "x" * 50 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é" * 90
    rows = [(i, f"http://u/{i}", trap + str(i % 3) + "WARC/1.1\r\n" * (i % 5)) for i in range(120)]
    rows += [(1000, None, None), (1001, "a\r\nb", ""), (None, "n", "z" * 200), (5000, "d", "q" * 300), (5000, "d", "q" * 300)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = scratch(spark, "warc")
        warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), out)
        got = warc.read_archive(spark, out).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    raw = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i, _, h in rows:
        if i is not None and len(raw[i]) >= 100:
            first[raw[i]] = min(i, first.get(raw[i], i))
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, _, _ in rows) and all(r.digest_ok for r in got)
    for r in got:
        body = raw[r.page_id]
        to = first.get(body)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", to) if to not in (None, r.page_id) and r.page_id is not None else ("response", None))


def test_warc_query_equals_its_sql(spark):
    from vintage.plans.check import compare
    assert compare(spark, SF, "op2_warc", queries.QUERIES["op2_warc"], queries.ORACLES["op2_warc"])["status"] == "ok"


def test_toxicity_on_held_out_texts():
    sf = "/root/testdata/sf0.01"
    rows = pq.read_table(f"{sf}/documents.parquet").to_pandas().merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    rows = rows[(rows.lang == "en")]
    held = rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)
    fit, test = rows[~held], rows[held]
    model = toxicity.train(fit.text.tolist(), fit.toxic.to_numpy(), fit.lang.tolist())
    score, y = model.scores(test.text.tolist()), test.toxic.to_numpy()
    assert ((score >= 0.7) == y).mean() >= 0.93
    assert np.mean(score[y == 1][:, None] > score[y == 0][None]) > 0.95
    long = " ".join(test.text[y == 1].iloc[0] for _ in range(200)) + " fine" * 70_000
    assert 0 <= model.scores(["", long])[0] <= 1 and model.scores([long])[0] >= 0.5


def test_languages(spark, docs, local):
    got = langid.identify(langid.document_evidence(docs), langid.document_model(docs), ["doc_id"]).toPandas().set_index("doc_id")
    assert (got.text_lang[local.doc_id].to_numpy() == local.lang.to_numpy()).mean() > 0.97
    assert got.kept.mean() > 0.98
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = langid.identify(langid.page_evidence(pages), langid.document_model(docs), ["page_id"]).toPandas()
    assert len(found) == pages.count() and found.kept.mean() > 0.98


def test_evidence_of_an_address(spark):
    url = F.col("u")
    rows = spark.createDataFrame([("https://me@blog.Example.co.uk:8080/x?y#z",), ("nonsense",), (None,)], "u string")
    host = langid.host_of(url)
    got = rows.select(host.alias("h"), langid.domain_of(host).alias("d"), langid.suffix_of(host).alias("s"),
                      langid.declared_in(F.lit('<HTML class="a" lang=\'FR-ca\'>')).alias("l")).collect()
    assert tuple(got[0]) == ("blog.example.co.uk", "co.uk", "uk", "fr")
    assert got[1].h == "" and got[2].h is None


def test_shards_are_ordered_by_number(spark, docs, tmp_path):
    import pathlib
    import shutil
    path, out = queries.tokenizer_file("byte_bpe_50k.json"), tmp_path / "ids"
    token_output.write_token_files(docs, str(out), path, shard_bytes=1)
    want = {r.doc_id: r.start for r in token_output.read_token_files(spark, str(out), 2).collect()}
    parts = sorted(x for x in pathlib.Path(out).glob("part-*") if x.stat().st_size)
    assert len(parts) > 2
    moved = tmp_path / "moved"
    moved.mkdir()
    for k, x in enumerate(parts):  # from part-99999 on, the text order of names is another
        shutil.copy(x, moved / f"part-{99_999 + k}-{x.name.split('-', 2)[2]}")
    assert {r.doc_id: r.start for r in token_output.read_token_files(spark, str(moved), 2).collect()} == want
    nothing = token_output.lookup(spark, str(out), spark.createDataFrame([], "doc_id long"), 2)
    assert nothing.count() == 0
    some = docs.limit(3).select("doc_id")
    assert token_output.lookup(spark, str(out), some.union(some), 2).count() == docs.join(some, "doc_id").count()


def test_a_worker_encodes_small_portions():
    """What a worker holds at a time is half a million characters and a text."""
    import pyarrow as pa
    own = list(token_output.portions(pa.array(["x" * 1_000] * 3_000 + [None])))
    assert sum(map(len, own)) == 3_001 and max(sum(map(len, p)) for p in own) <= token_output.PORTION + 1_000 <= 600_000


def test_a_word_is_encoded_once_in_a_block(monkeypatch):
    """Words that aren't remembered are not encoded anew by each portion, and stems not by each mark behind them."""
    import pyarrow as pa
    path, learned = queries.tokenizer_file("byte_bpe_50k.json"), []
    monkeypatch.setattr(token_output, "REMEMBERED", 5)
    pieces = token_output.Pieces(path, 2)
    of_letters = pieces.letters
    monkeypatch.setattr(pieces, "letters", lambda words: learned.extend(words.to_pylist()) or of_letters(words))
    words = ["".join(chr(97 + (k // 26**i + i) % 26) for i in range(4)) for k in range(3_000)]
    texts = [f"x {' '.join(w + '.,!'[k % 3] if (k + j) % 2 else w for j, w in enumerate(words))}" for k in range(120)]
    portions = list(token_output.portions(pa.array(texts)))
    assert len(portions) > 2
    (block,) = token_output.blocks(map(token_output.Split, portions), 1 << 22)
    got = pieces.encode_all(block).to_pylist()
    assert sorted(learned) == sorted(words)
    tokenizer = token_output.load_tokenizer(path)
    assert got == [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_letters_of_many_scripts_and_what_follows(monkeypatch):
    """The letters a word begins with and the rest encode as the whole does, in calls of any size, blocks of any size."""
    import random
    path, rnd = queries.tokenizer_file("byte_bpe_50k.json"), random.Random(7)
    signs = ["a", "Z", "ß", "é", "ж", "漢", "ا", "ก", "\u0e31", "e\u0301", "²", "½", "ª", "5", "_", "'s", "'", "’ll", ".", "!?", "\n", "\n\n", "\t", "\xa0", "\u3000",
             "\x1f", "\x85", "😀", "<|endoftext|>", " ", "  ", " ", " "]
    texts = ["".join(rnd.choices(signs, k=rnd.randrange(40))) for _ in range(1_500)]
    tokenizer = token_output.load_tokenizer(path)
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for together, remembered, size in ((1, 100, 1 << 20), (16, 0, 1 << 20), (7, 300, 500)):
        monkeypatch.setattr(token_output, "TOGETHER", together)
        monkeypatch.setattr(token_output, "REMEMBERED", remembered)
        pieces = token_output.Pieces(path, 2)
        cut = (token_output.Split(texts[i:i + 20]) for i in range(0, len(texts), 20))
        assert [x for block in token_output.blocks(cut, size) for x in pieces.encode_all(block).to_pylist()] == want
    pieces.opens = ~pieces.opens  # calls that seem to show another number of words
    assert pieces.encode(texts) == want
