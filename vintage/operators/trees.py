"""Regression trees over cohort matrices: forests and boosted trees of every
segment, and of every draw and fold of a search, in one Spark job.

A unit of work is a block of a forest's trees, or a whole boosting run (whose
rounds depend on each other), on the matrix of one segment. A matrix has at
most months x months cells, so a unit's rows have a fixed bound; segments,
blocks, folds and families of settings make the job as wide as needed. Cells
to predict travel with the cells to learn from and go down the trees while
they grow, so no tree is kept: a unit returns sums of predictions, and the
rest (means over the trees, scores, ranking) is DataFrame code.

Forest (L2): trees on n draws with replacement of n cells, exact splits
between any two indices, both features or one drawn by node, no depth limit.
All trees of a block grow together, a level at a time, from cumulated sums of
values scaled to whole numbers; so scores, ties and trees don't depend on the
order of sums. A tie goes to the row index, then to the lower threshold. As in
the reference's library a cell drawn twice weighs double but counts once.

Boosting (L3): squared error, 100 rounds, rate 0.1; a tree splits the open leaf
of the highest gain until it has 31 leaves of at least 20 cells. Features with
more than 255 distinct values are cut at quantiles.

Search (L8-L10): of two settings that differ in the number of trees, the depth
limit or ``min_samples_split`` only, one forest is a part of the other: fewer
trees, or the same trees cut short. So the whole space needs a forest per fold,
``min_samples_leaf`` and number of features, each grown once without limits;
the predictions of all other settings are read off on the way down."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.session import dealt, materialize, ship

_M64 = (1 << 64) - 1
#: Trees of a forest that one task grows.
BLOCK = 25
#: The reference's boosting (its library's defaults).
ROUNDS, RATE, LEAVES, LEAST_IN_LEAF, BINS = 100, 0.1, 31, 20, 255


def mix(x: np.ndarray | int) -> np.ndarray:
    """splitmix64, the source of all draws."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tree_key(seed: int, tree: int) -> int:
    return int(mix((seed << 32 | tree) & _M64))


def weights(n: int, key: int) -> np.ndarray:
    """How often each of ``n`` cells is drawn in ``n`` draws."""
    with np.errstate(over="ignore"):
        drawn = mix(np.uint64(key) + np.arange(n, dtype=np.uint64))
    return np.bincount((drawn % np.uint64(n)).astype(np.int64), minlength=n)


@dataclass(frozen=True)
class Forest:
    """A unit: trees ``first`` .. ``first + n - 1``. Predictions are summed for
    each limit of ``depths`` (None: no limit) and of ``splits``. ``fold``: the
    cells of this fold are predicted from the others."""
    first: int
    n: int
    seed: int
    leaf: int = 1
    one_feature: bool = False
    depths: tuple[int | None, ...] = (None,)
    splits: tuple[int, ...] = (2,)
    fold: int | None = None

    def run(self, x: np.ndarray, y: np.ndarray, q: np.ndarray, scale: float) -> np.ndarray:
        return forest(x, np.rint(y * scale).astype(np.int64), q, scale, self)


@dataclass(frozen=True)
class Boosting:
    """A unit: the whole sequence of trees."""
    fold: int | None = None

    def run(self, x: np.ndarray, y: np.ndarray, q: np.ndarray, scale: float) -> np.ndarray:
        return boost(x, y, q)[None]


def best_by_node(node: np.ndarray, x: np.ndarray, w: np.ndarray, wy: np.ndarray, k: int, leaf: int) -> tuple[np.ndarray, ...]:
    """For each of ``k`` nodes the best score of a split on ``x`` and its
    threshold, and whether ``x`` varies there. ``node`` may be in any order."""
    order = np.lexsort((x, node))
    node, x = node[order], x[order]
    start = np.searchsorted(node, np.arange(k + 1))
    sums = [np.concatenate([[0], np.cumsum(c[order])]) for c in (w, wy)]
    at = np.flatnonzero((node[1:] == node[:-1]) & (x[1:] != x[:-1]))
    own, low, high = node[at], start[node[at]], start[node[at] + 1]
    varies = np.zeros(k, bool)
    varies[own] = True
    fits = (at + 1 - low >= leaf) & (high - at - 1 >= leaf)
    at, own, low, high = at[fits], own[fits], low[fits], high[fits]
    (lw, lwy), (rw, rwy) = ([s[at + 1] - s[low] for s in sums], [s[high] - s[at + 1] for s in sums])
    score = lwy.astype(float) ** 2 / lw + rwy.astype(float) ** 2 / rw
    best, cut = np.full(k, -np.inf), np.zeros(k)
    np.maximum.at(best, own, score)
    hit = np.flatnonzero(score == best[own])[::-1]  # the lowest threshold is written last
    cut[own[hit]] = (x[at[hit]] + x[at[hit] + 1]) / 2
    return best, cut, varies


def forest(x: np.ndarray, y: np.ndarray, q: np.ndarray, scale: float, unit: Forest) -> np.ndarray:
    """Sums over the unit's trees of the predictions for ``q``: a row for each
    pair of a depth limit and a split limit."""
    keys = [tree_key(unit.seed, unit.first + t) for t in range(unit.n)]
    drawn = [weights(len(x), k) for k in keys]
    row = np.concatenate([np.flatnonzero(d) for d in drawn])
    node = np.repeat(np.arange(unit.n), [np.count_nonzero(d) for d in drawn])
    w = np.concatenate([d[d > 0] for d in drawn])
    asked, at = np.tile(np.arange(len(q)), unit.n), np.repeat(np.arange(unit.n), len(q))
    slot = np.arange(len(asked))
    name, k, depth = np.array(keys, np.uint64), unit.n, 0
    value = np.zeros((len(unit.splits), len(asked)))
    settled = np.zeros((len(unit.splits), len(asked)), bool)
    taken: dict[int | None, np.ndarray] = {}
    while k:
        order = np.argsort(node, kind="stable")
        node, row, w = node[order], row[order], w[order]
        start = np.searchsorted(node, np.arange(k))
        n, own = np.diff(np.append(start, len(node))), y[row]
        wy = w * own
        mean = np.add.reduceat(wy, start) / (np.add.reduceat(w, start) * scale)
        for s, least in enumerate(unit.splits):
            open_ = slot[~settled[s, slot]]
            here = at[~settled[s, slot]]
            value[s, open_] = mean[here]
            settled[s, open_] = n[here] < least
        if depth in unit.depths:
            taken[depth] = value.copy()
        pure = np.minimum.reduceat(own, start) == np.maximum.reduceat(own, start)
        may = (n >= 2 * unit.leaf) & ~pure
        live = may[node]
        found = [best_by_node(node[live], x[row[live], f], w[live], wy[live], k, unit.leaf) for f in (0, 1)]
        (score0, cut0, varies0), (score1, cut1, varies1) = found
        if unit.one_feature:
            second = np.where(name & np.uint64(1) == 1, varies1, ~varies0)
        else:
            second = score1 > score0
        split = np.where(second, score1, score0) > -np.inf
        cut = np.where(second, cut1, cut0)
        rank = np.cumsum(split) - 1
        live = split[node]
        node, row, w = node[live], row[live], w[live]
        go = np.where(second[node], x[row, 1], x[row, 0]) > cut[node]
        node = 2 * rank[node] + go
        moves = split[at]
        at, slot = at[moves], slot[moves]
        go = np.where(second[at], q[asked[slot], 1], q[asked[slot], 0]) > cut[at]
        at = 2 * rank[at] + go
        with np.errstate(over="ignore"):
            name = mix(np.repeat(name[split], 2) * np.uint64(2) + np.tile(np.array([0, 1], np.uint64), int(split.sum())))
        k, depth = 2 * int(split.sum()), depth + 1
    out = [np.bincount(asked, taken.get(d, value)[s], len(q)) for d in unit.depths for s in range(len(unit.splits))]
    return np.array(out)


def edges(x: np.ndarray) -> np.ndarray:
    """Thresholds between the bins of a feature."""
    own = np.unique(x)
    if len(own) <= BINS:
        return (own[1:] + own[:-1]) / 2
    return np.unique(np.percentile(x, np.linspace(0, 100, BINS + 1)[1:-1], method="midpoint"))


def boost(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Predictions of gradient-boosted trees for ``q``."""
    cuts = [edges(x[:, f]) for f in (0, 1)]
    code = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]
    code_q = [np.searchsorted(c, q[:, f]) for f, c in enumerate(cuts)]
    fitted, out = np.full(len(x), y.mean()), np.full(len(q), y.mean())

    def best_split(rows: np.ndarray, g: np.ndarray) -> tuple:
        """(gain, feature, bin) of the best split; gain 0 if there is none."""
        best, total = (0.0, 0, 0), g[rows].sum()
        for f in (0, 1):
            n = np.cumsum(np.bincount(code[f][rows], minlength=len(cuts[f]) + 1))[:-1]
            s = np.cumsum(np.bincount(code[f][rows], g[rows], len(cuts[f]) + 1))[:-1]
            ok = np.flatnonzero((n >= LEAST_IN_LEAF) & (len(rows) - n >= LEAST_IN_LEAF))
            if len(ok):
                gain = s[ok] ** 2 / n[ok] + (total - s[ok]) ** 2 / (len(rows) - n[ok]) - total ** 2 / len(rows)
                if gain.max() > best[0]:
                    best = (float(gain.max()), f, int(ok[gain.argmax()]))
        return best

    for _ in range(ROUNDS):
        g, done, heap, made = fitted - y, [], [], 0

        def put(rows: np.ndarray, asked: np.ndarray) -> None:
            gain, f, b = best_split(rows, g) if len(rows) >= 2 * LEAST_IN_LEAF else (0.0, 0, 0)
            if gain > 0:
                heapq.heappush(heap, (-gain, made, f, b, rows, asked))
            else:
                done.append((rows, asked))

        put(np.arange(len(x)), np.arange(len(q)))
        while heap and len(heap) + len(done) < LEAVES:
            _, _, f, b, rows, asked = heapq.heappop(heap)
            left, left_q = code[f][rows] <= b, code_q[f][asked] <= b
            for side, side_q in ((left, left_q), (~left, ~left_q)):
                made += 1
                put(rows[side], asked[side_q])
        for rows, asked in done + [h[4:] for h in heap]:
            step = -RATE * g[rows].sum() / len(rows)
            fitted[rows] += step
            out[asked] += step
    return out


# ---------------------------------------------------------------- Spark
def run_units(cells: DataFrame, units: list[Forest | Boosting], seg: list[str], places: int) -> DataFrame:
    """``cells`` (seg, row_idx, col_idx, value, ``is_query``, ``fold``) through
    all units: (seg, row_idx, col_idx, unit, variant, total) for each cell a
    unit predicts. Cells without a finite value are never learned from; a unit
    with none to learn from predicts nothing."""
    spark = cells.sparkSession
    ship(spark)
    key = [*seg, "unit"]
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    rows = cells.select(*seg, "row_idx", "col_idx", finite.alias("value"), "is_query", "fold",
                        F.explode(F.sequence(F.lit(0), F.lit(len(units) - 1))).alias("unit"))
    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in seg], "row_idx int, col_idx int, unit int, variant int, total double"])
    scale = 10.0 ** places

    def run(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["row_idx", "col_idx"], kind="stable")
        unit = units[int(pdf["unit"].iloc[0])]
        asked = pdf["is_query"].to_numpy(bool) if unit.fold is None else pdf["fold"].to_numpy() == unit.fold
        learn = pdf[~asked & pdf["value"].notna().to_numpy() & ~pdf["is_query"].to_numpy(bool)]
        query = pdf[asked]
        where = ["row_idx", "col_idx"]
        base = query[[*seg, *where, "unit"]]
        if learn.empty or query.empty:
            return base.iloc[:0].assign(variant=0, total=0.0)
        found = unit.run(learn[where].to_numpy(np.int64), learn["value"].to_numpy(float), query[where].to_numpy(np.int64), scale)
        return pd.concat([base.assign(variant=v, total=t) for v, t in enumerate(found)])

    return dealt(rows, *key).groupBy(*key).applyInPandas(run, schema)


def forest_units(trees: int, block: int = BLOCK, **settings) -> list[Forest]:
    return [Forest(first, min(block, trees - first), **settings) for first in range(0, trees, block)]


def ordered_sum(block: str, value: str):
    """Sum in the order of ``block``, the same whatever the partitions."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(block, value))), F.lit(0.0), lambda a, x: a + x[value])


def predictions(cells: DataFrame, seg: list[str], places: int, trees: int, seed: int) -> DataFrame:
    """Forest and boosted predictions (seg, row_idx, col_idx, model,
    prediction) of the cells marked ``is_query`` from the others."""
    forests = forest_units(trees, seed=seed)
    cells = cells.withColumn("fold", F.lit(None).cast("int"))
    found = run_units(cells, [*forests, Boosting()], seg, places)
    boosted = F.col("unit") == len(forests)
    per = found.withColumn("model", F.when(boosted, "Bayesian").otherwise("Random Forest"))
    total = ordered_sum("unit", "total")
    return (per.groupBy(*seg, "row_idx", "col_idx", "model").agg(total.alias("_sum"))
            .select(*seg, "row_idx", "col_idx", "model",
                    (F.col("_sum") / F.when(F.col("model") == "Bayesian", 1).otherwise(trees)).alias("prediction")))


def search_predictions(cells: DataFrame, draws: list[dict], seg: list[str], places: int, folds: int, seed: int,
                       block: int = 100) -> DataFrame:
    """Cross-validated predictions of every draw: (seg, row_idx, col_idx,
    fold, draw, prediction). ``cells`` have their ``fold``. ``block`` divides
    every draw's number of trees."""
    trees = max(d["n_estimators"] for d in draws)
    if any(d["n_estimators"] % block for d in draws):
        raise ValueError("block must divide the numbers of trees")
    one = lambda d: d["max_features"] != "auto"  # noqa: E731  of two features, sqrt and log2 are one
    depths = sorted({d["max_depth"] for d in draws}, key=lambda x: (x is None, x))
    splits = sorted({d["min_samples_split"] for d in draws})
    families = sorted({(d["min_samples_leaf"], one(d)) for d in draws})
    units, family_of = [], []
    for fold in range(folds):
        for f, (leaf, single) in enumerate(families):
            new = forest_units(trees, block, seed=(seed << 8) + fold, leaf=leaf, one_feature=single,
                               depths=tuple(depths), splits=tuple(splits), fold=fold)
            units += new
            family_of += [f] * len(new)
    found = run_units(cells.withColumn("is_query", F.lit(False)), units, seg, places)
    spark = cells.sparkSession
    of_unit = spark.createDataFrame([(u, family_of[u], x.fold, x.first) for u, x in enumerate(units)], "unit int, family int, fold int, first int")
    of_draw = spark.createDataFrame(
        [(i, families.index((d["min_samples_leaf"], one(d))), depths.index(d["max_depth"]) * len(splits) + splits.index(d["min_samples_split"]),
          d["n_estimators"]) for i, d in enumerate(draws)], "draw int, family int, variant int, n_estimators int")
    where = [*seg, "row_idx", "col_idx", "fold"]
    found = materialize(found.join(F.broadcast(of_unit), "unit"))  # broadcast tables of the settings, not of data
    joined = found.join(F.broadcast(of_draw), ["family", "variant"]).where("first < n_estimators")
    return (joined.groupBy(*where, "draw", "n_estimators").agg(ordered_sum("first", "total").alias("_sum"))
            .select(*where, "draw", (F.col("_sum") / F.col("n_estimators")).alias("prediction")))
