"""Forests, boosting and the random search against plain-Python twins."""

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from vintage.operators import cells as C
from vintage.operators import impute as IM
from vintage.operators import trees as T
from vintage.params import FIXTURE_PARAMS as P
from vintage.params import FOREST_TREES, MODEL_SEED
from vintage.session import materialize
from vintage.sources import transactions_from_tables

M64 = (1 << 64) - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_tree(rows, leaf, one_feature, name, depth=0):
    """rows: (x0, x1, y, weight) -> nested nodes (mean, n, depth, split, children)."""
    w, wy = sum(r[3] for r in rows), sum(r[2] * r[3] for r in rows)
    node = {"mean": wy, "w": w, "n": len(rows), "depth": depth, "split": None}
    if len({r[2] for r in rows}) == 1:
        return node
    best, varies = [None, None], [False, False]
    for f in (0, 1):
        own = sorted({r[f] for r in rows})
        varies[f] = len(own) > 1
        for low, high in zip(own, own[1:], strict=False):
            left, right = [r for r in rows if r[f] <= low], [r for r in rows if r[f] >= high]
            if len(left) >= leaf and len(right) >= leaf:
                parts = [(float(sum(r[2] * r[3] for r in x)), sum(r[3] for r in x)) for x in (left, right)]
                score = sum(s * s / m for s, m in parts)
                if best[f] is None or score > best[f][0]:
                    best[f] = (score, (low + high) / 2)
    if one_feature:
        f = (1 if varies[1] else 0) if name & 1 else (0 if varies[0] else 1)
    else:
        f = 1 if best[1] and (not best[0] or best[1][0] > best[0][0]) else 0
    if best[f]:
        cut = best[f][1]
        node["split"] = (f, cut)
        node["children"] = [plain_tree([r for r in rows if (r[f] > cut) == side], leaf, one_feature, mix((2 * name + side) & M64), depth + 1)
                            for side in (False, True)]
    return node


def plain_predict(node, q, scale, max_depth, min_split):
    while node["split"] and node["depth"] != max_depth and node["n"] >= min_split:
        f, cut = node["split"]
        node = node["children"][q[f] > cut]
    return node["mean"] / (node["w"] * scale)


def matrix(rng, n=120, side=14, values=None):
    cells = rng.sample([(a, b) for a in range(side) for b in range(side)], n)
    return [(a, b, rng.choice(values) if values else rng.randrange(10_000)) for a, b in cells]


@pytest.mark.parametrize("leaf,one,values", [(1, False, None), (2, True, None), (4, False, [1, 2, 3]), (1, True, [5, 5, 7])])
def test_forest_equals_plain_trees(leaf, one, values):
    rng = random.Random(leaf)
    data = matrix(rng, values=values)
    learn, ask = data[:80], data[80:]
    depths, splits = (2, 5, None), (2, 5, 10)
    unit = T.Forest(3, 6, seed=11, leaf=leaf, one_feature=one, depths=depths, splits=splits)
    x, y = np.array([r[:2] for r in learn]), np.array([r[2] for r in learn]) / 10_000
    got = unit.run(x, y, np.array([r[:2] for r in ask]), 10_000.0)
    want = np.zeros_like(got)
    for t in range(3, 9):
        key = mix(11 << 32 | t)
        drawn = [mix((key + i) & M64) % 80 for i in range(80)]
        tree = plain_tree([(*r, drawn.count(i)) for i, r in enumerate(learn) if i in drawn], leaf, one, key)
        for v, (d, s) in enumerate((d, s) for d in depths for s in splits):
            want[v] += [plain_predict(tree, q, 10_000.0, d, s) for q in ask]
    assert np.array_equal(got, want)


def plain_boost(learn, ask, rounds, leaves, least, rate):
    fitted = [sum(r[2] for r in learn) / len(learn)] * len(learn)
    out = [fitted[0]] * len(ask)
    for _ in range(rounds):
        g = [p - r[2] for p, r in zip(fitted, learn, strict=True)]

        def split_of(rows, g=g):
            best, total = (0.0,), sum(g[i] for i in rows)
            for f in (0, 1):
                own = sorted({r[f] for r in learn})
                for low, high in zip(own, own[1:], strict=False):
                    left, right = [i for i in rows if learn[i][f] <= low], [i for i in rows if learn[i][f] >= high]
                    if min(len(left), len(right)) >= least:
                        a, b = sum(g[i] for i in left), sum(g[i] for i in right)
                        gain = a * a / len(left) + b * b / len(right) - total * total / len(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, (low + high) / 2)
            return best
        open_ = [(list(range(len(learn))), list(range(len(ask))))]
        while len(open_) < leaves:
            found = [split_of(rows) for rows, _ in open_]
            k = max(range(len(open_)), key=lambda k: found[k][0])
            if found[k][0] <= 0:
                break
            (_, f, cut), (rows, asked) = found[k], open_.pop(k)
            open_ += [([i for i in rows if (learn[i][f] > cut) == side], [i for i in asked if (ask[i][f] > cut) == side]) for side in (False, True)]
        for rows, asked in open_:
            step = -rate * sum(g[i] for i in rows) / len(rows)
            for i in rows:
                fitted[i] += step
            for i in asked:
                out[i] += step
    return out


def test_boosting_equals_plain_best_first_trees(monkeypatch):
    for name, v in (("ROUNDS", 8), ("LEAVES", 6), ("LEAST_IN_LEAF", 5)):
        monkeypatch.setattr(T, name, v)
    data = matrix(random.Random(4))
    learn, ask = data[:90], data[90:]
    got = T.boost(np.array([r[:2] for r in learn]), np.array([r[2] for r in learn], float), np.array([r[:2] for r in ask]))
    assert got == pytest.approx(plain_boost(learn, ask, 8, 6, 5, 0.1), rel=1e-9)


def test_bins_of_many_values():
    assert len(T.edges(np.arange(255))) == 254 and len(T.edges(np.arange(5000))) <= 254
    assert len(T.edges(np.array([3, 3]))) == 0


@pytest.fixture(scope="module")
def cells(spark):
    return materialize(C.cohort_cells(transactions_from_tables(spark, SF), P))


@pytest.fixture(scope="module")
def by_country(spark):
    p = P.with_(country=None, segment_cols=("country",))
    return p, materialize(C.cohort_cells(transactions_from_tables(spark, SF), p))


def plain_r2(pairs):
    y = [a for a, _ in pairs]
    mean = sum(y) / len(y)
    return 1 - sum((a - b) ** 2 for a, b in pairs) / sum((a - mean) ** 2 for a in y)


def test_scores_follow_from_the_predictions(cells):
    preds = IM.test_predictions(cells, "retention", P).collect()
    scores = {r.model: r for r in IM.model_scores(cells, "retention", P).collect()}
    assert set(scores) == set(IM.MODEL_ORDER) and sum(r.is_best for r in scores.values()) == 1
    for model, r in scores.items():
        assert r.r2 == pytest.approx(plain_r2([(x.value, x.prediction) for x in preds if x.model == model]), rel=1e-9)
    assert max(scores.values(), key=lambda r: r.r2).is_best


def test_forest_prediction_of_a_matrix_is_the_mean_of_its_trees(cells):
    s = IM.split(IM.matrix_cells(cells, "retention", P), P).toPandas().sort_values(["row_idx", "col_idx"])
    learn, ask = s[~s.is_test], s[s.is_test]
    where = ["row_idx", "col_idx"]
    want = T.Forest(0, FOREST_TREES, seed=MODEL_SEED).run(learn[where].to_numpy(), learn.value.to_numpy(), ask[where].to_numpy(), 1e4)[0] / FOREST_TREES
    got = IM.test_predictions(cells, "retention", P).where("model = 'Random Forest'").toPandas().sort_values(where)
    assert got.prediction.to_numpy() == pytest.approx(want, rel=1e-12)


def test_segments_equal_runs_of_each_alone(by_country):
    p, cells = by_country
    filled = IM.best_filled(cells, "retention", p).toPandas()
    scores = IM.model_scores(cells, "retention", p).toPandas()
    for country in sorted(scores.country.unique())[:3]:
        alone = cells.where(F.col("country") == country).drop("country")
        one = IM.model_scores(alone, "retention", P).toPandas()
        own = scores[scores.country == country]
        assert {(r.model, r.r2, r.is_best) for r in own.itertuples()} == {(r.model, r.r2, r.is_best) for r in one.itertuples()}
        where = ["row_idx", "col_idx"]
        a = filled[filled.country == country].sort_values(where).drop(columns="country").reset_index(drop=True)
        b = IM.best_filled(alone, "retention", P).toPandas().sort_values(where).reset_index(drop=True)
        assert a.equals(b)


def test_search_equals_separate_forests(cells):
    got = {r.draw: r for r in IM.random_search(cells, "retention", P, n_iter=6, folds=2, seed=7).collect()}
    draws = IM.search_draws(6, 7)
    train = IM.with_fold(IM.split(IM.matrix_cells(cells, "retention", P), P).where("not is_test"), 2, 7).toPandas().sort_values(["row_idx", "col_idx"])
    where = ["row_idx", "col_idx"]
    for i, d in enumerate(draws):
        scores = []
        for fold in (0, 1):
            learn, ask = train[train.fold != fold], train[train.fold == fold]
            unit = T.Forest(0, d["n_estimators"], seed=(7 << 8) + fold, leaf=d["min_samples_leaf"], one_feature=d["max_features"] != "auto",
                            depths=(d["max_depth"],), splits=(d["min_samples_split"],))
            found = unit.run(learn[where].to_numpy(), learn.value.to_numpy(), ask[where].to_numpy(), 1e4)[0] / d["n_estimators"]
            scores.append(plain_r2(list(zip(ask.value, found, strict=True))))
        assert got[i].cv_r2 == pytest.approx(sum(scores) / 2, rel=1e-9)
        assert (got[i].n_estimators, got[i].max_features, got[i].max_depth) == (d["n_estimators"], d["max_features"], d["max_depth"])
    assert [r.draw for r in got.values() if r.is_best] == [max(got, key=lambda i: got[i].cv_r2)]


def test_edges_of_matrices(spark):
    """No finite value to learn from, nothing to ask, repeated values, one cell."""
    fields = "seg string, row_idx int, col_idx int, value double, is_query boolean"
    rows = [("inf", 0, 0, float("inf"), False), ("inf", 0, 1, None, False), ("inf", 1, 1, None, True), ("none", 0, 0, 1.0, False),
            ("one", 0, 0, 2.5, False), ("one", 5, 5, None, True), ("flat", 0, 0, 1.0, False), ("flat", 0, 1, 1.0, False), ("flat", 3, 0, None, True)]
    got = {(r.seg, r.model): r.prediction for r in T.predictions(spark.createDataFrame(rows, fields), ["seg"], 1, 30, 1).collect()}
    assert got == {("one", "Random Forest"): 2.5, ("one", "Bayesian"): 2.5, ("flat", "Random Forest"): 1.0, ("flat", "Bayesian"): 1.0}
    assert T.predictions(spark.createDataFrame([], fields), ["seg"], 1, 30, 1).count() == 0
