"""b-bit MinHash near-dedup against all pairs of whole sets."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.llm import bbit_minhash as bb
from vintage.llm import common
from vintage.llm.common import components, ship

FIELDS = "doc_id long, text string"


def plain_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    pairs = {p for ks in where.values() for p in combinations(ks, 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    out = []
    for k, (d, _) in enumerate(rows):
        c = least.get(top(k)) if sets[k] else d
        out.append((d, len(sets[k]), c, d == c))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def compare(spark, df):
    ship(spark)
    got = sorted((tuple(r) for r in bb.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=key)
    assert got == sorted(plain([tuple(r) for r in df.select("doc_id", "text").collect()]), key=key)
    return got


def near_copies(rng, n, at=0, words=60):
    """``n`` texts, each with a few words of one base text changed."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(words)] = f"v{rng.randrange(10_000)}"
        out.append((at + k, " ".join(own)))
    return out


def test_documents(spark):
    got = compare(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sum(not r[3] for r in got) > 5


def test_groups_over_several_portions(spark, monkeypatch):
    monkeypatch.setattr(bb, "PORTION", 16)
    rng = random.Random(1)
    rows = near_copies(rng, 120, 0, 150) + near_copies(rng, 60, 1000, 120) + [(5000 + k, f"one two three four {k % 7}") for k in range(50)]
    got = compare(spark, spark.createDataFrame(rows, FIELDS))
    assert len({r[2] for r in got}) < 60


def test_members_outside_the_largest_component_meet_all(spark, monkeypatch):
    """Buckets of 40 classes in portions of 4, not yet connected."""
    monkeypatch.setattr(bb, "PORTION", 4)
    rows = [(n, 0, 40 // 4, k % 10, f"{k:03d}".encode(), k) for n, k in enumerate(range(40))]
    met = spark.createDataFrame([(7, m, h, name, i) for _, _, m, h, name, i in rows], "bucket long, m int, h int, name binary, id int")
    roots = spark.createDataFrame([(f"{k:03d}".encode(), f"{k % 3 if k < 30 else k:03d}".encode()) for k in range(40)], "a binary, root binary")
    seen = set()
    for _, t in bb._across(met, roots).toPandas().groupby(["bucket", "i", "j"]):
        left, right = t[t.h == t.i], t[t.h == t.j]
        assert len(left) and len(right)
        seen |= {frozenset((a, b)) for a in left.id for b in right.id}
    root = lambda k: k % 3 if k < 30 else k
    assert {frozenset((a, b)) for a, b in combinations(range(40), 2) if root(a) != root(b)} <= seen


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8, 0.95):
        out = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            n = round(2000 * share)
            a = np.unique(np.concatenate([both[:n], rng.integers(0, 1 << 63, (2000 - n) // 2, dtype=np.uint64)]))
            b = np.unique(np.concatenate([both[:n], rng.integers(0, 1 << 63, (2000 - n) // 2, dtype=np.uint64)]))
            sigs = [np.frombuffer(bb.packed(bb.minima(x)), "<u8")[None] for x in (a, b)]
            out.append(bb.estimate(bb.agreeing(*sigs))[0])
        assert abs(np.mean(out) - share) < 0.03
    assert bb.estimate(bb.least_agreeing()) > 0.4


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_with_heavy_names(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 900)] + [(k, k + 1) for k in range(2000, 2040)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(150)]
    up = {}
    top = lambda x: x if up.setdefault(x, x) == x else top(up[x])
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.a: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in {x for e in edges for x in e}:
        assert got.get(x, x) == top(x)


ROWS = [(1, "A b C d e"), (1, "A b C d e"), (2, "a B c D E"), (3, None), (4, ""), (5, ""), (6, "\n\t \x0b"), (None, "a b c d e"), (None, "lone text of nobody"),
        (-7, "one two"), (8, "one two"), (9, "One  Two"), (10, "two one"), (11, "Ä b c d"), (12, "ä b c d"), (13, "x y z"), (14, "x y z"),
        (15, "long text here " * 30_000), (16, "long text here " * 20_000), (17, "a b c d e\x1cf"), (-2**63, "least"), (2**63 - 1, "least")]


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
def test_edges(spark, kind):
    df = spark.createDataFrame([] if kind == "empty" else ROWS, FIELDS)
    if kind == "clashes":
        df = df.select("*", *[F.lit("x").alias(c) for c in ("tid", "key", "n", "name", "root", "bucket", "bands", "sig", "_found", "m", "h")])
    got = compare(spark, df)
    assert len(got) == (0 if kind == "empty" else len(ROWS))
