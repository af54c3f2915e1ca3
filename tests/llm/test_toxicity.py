"""Toxicity: the convolution against plain loops, thresholds, held-out labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.llm import toxicity as tx
from vintage.llm.common import ship, words


def table(n=260, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        own = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(8, 40))]
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["vile", "nasty", "rotten"])
            own[rng.randrange(len(own))] = rng.choice(["vile", "nasty", "rotten"])
        rows.append((k, " ".join(own), rng.choice(["en", "de", "xx"])))
        labels.append((k, int(toxic)))
    return rows, labels


def test_convolution_equals_plain_loops(monkeypatch):
    rows, labels = table(80)
    model = tx.learn([r[1] for r in rows], np.array([y for _, y in labels]))
    texts = [r[1] for r in rows[:12]] + ["", "one", "two words", "w1 " * 90]
    want = []
    for text in texts:
        own = [model.table[tx.buckets([w])[0]].reshape(-1).astype(float) for w in words(text)]
        total = model.shift
        for k, w in enumerate(tx.WIDTHS):
            padded = own + [np.zeros(tx.CHANNELS * tx.DIM)] * (max(tx.WIDTHS) - 1)
            for f in range(tx.FILTERS):
                best = max(sum(float(padded[i + j] @ model.filters[k][j][:, f]) for j in range(w) if i + j < len(padded))
                           for i in range(max(len(own), 1)))
                total += max(best + model.bias[k][f], 0) * model.out[k * tx.FILTERS + f]
        want.append(total)
    assert model.logits(texts) == pytest.approx(want, abs=1e-3)
    monkeypatch.setattr(tx, "SEGMENT", 7)  # texts in pieces, pooled over them
    assert model.logits(texts) == pytest.approx(want, abs=1e-3)


def plain_cut(z, y):
    best, where = -1, None
    for t in sorted(set(z)):
        hit = sum(1 for a, b in zip(z, y, strict=True) if a >= t and b)
        f1 = 2 * hit / (sum(a >= t for a in z) + sum(y))
        if f1 >= best:
            best, where = f1, t
    return where


def test_cuts_by_count_and_weight():
    rng = np.random.default_rng(1)
    y = np.repeat([1, 0], [100, 900])
    z = np.concatenate([rng.normal(2, 1, 100), rng.normal(-1, 1, 900)])
    bins = tx.bins_of(z)
    cut = tx.best_cut(bins, (y == 1) * 1.0, (y == 0) * 1.0)
    top = plain_cut((bins / tx.BINS).tolist(), y.tolist())
    assert top - 0.6 < cut <= top
    assert tx.best_cut(np.repeat(bins, 2), np.repeat(y == 1, 2) * 1.0, np.repeat(y == 0, 2) * 1.0) == cut
    models = []
    for times in (1, 2):
        m = tx.Model(np.zeros((1, tx.DIM)), [], [], np.zeros(0))
        lang = np.array(["en", "de"], object)[np.arange(1000) % 2]
        tx.set_cuts(m, list(np.repeat(lang, times)), np.repeat(y, times), np.repeat(bins, times), np.ones(1000 * times), np.ones(2))
        models.append(m)
    assert models[0].middle == models[1].middle and models[0].scale == models[1].scale
    thin = (y == 1) | (np.arange(1000) % 9 == 0)  # a ninth of the clean rows, weighed by nine
    assert abs(tx.best_cut(bins[thin], (y == 1)[thin] * 1.0, (y == 0)[thin] * 9.0) - cut) < 0.5


def test_every_language_with_toxic_rows_has_a_cut_drawn_to_the_global_one():
    y = np.array([1, 0] * 60 + [1, 0])
    z = np.array([3.0, -3.0] * 60 + [-2.0, -4.0])
    m = tx.Model(np.zeros((1, tx.DIM)), [], [], np.zeros(0))
    tx.set_cuts(m, ["en"] * 120 + ["fr"] * 2, y, tx.bins_of(z), np.ones(122), np.ones(2))
    assert set(m.thresholds) == {"en", "fr"} and m.thresholds["fr"] < tx.CUT


def test_held_out_labels_change_no_score(spark):
    ship(spark)
    rows, labels = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r[0] for r in docs.where(tx.remainder(F.col("doc_id")) == 1).select("doc_id").collect()}
    one = {r.doc_id: r for r in tx.held_out_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    flipped = [(k, 1 - y if k in held else y) for k, y in labels]
    other = {r.doc_id: r for r in tx.held_out_scores(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()}
    assert one == other and {k for k, r in one.items() if r.held_out} == held
    right = [one[k].predicted == y for k, y in labels if k in held]
    assert np.mean(right) > 0.9
    model = tx.fit(docs, sample := tx.sampled(spark.createDataFrame([x for x in labels if x[0] not in held], "doc_id long, toxic int")))
    tx.calibrate(model, tx.logits_of(docs, model, ["doc_id", "lang"]), sample)
    assert [one[k].score for k, _, _ in rows] == pytest.approx(model.scores([t for _, t, _ in rows]).tolist(), abs=1e-9)
