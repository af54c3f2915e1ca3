"""Filling the empty cells of a cohort matrix.

Matrix cells are long-form rows (segment, row_idx, col_idx, value). The
matrix of a segment is bounded by months x months whatever the data volume,
so every per-segment group below has a proven bound.

* k-NN (L4) is an exact band join, not a cross join: each query cell is
  matched to the training cells within its own Chebyshev radius R (equi-join
  on the row after exploding the query's row window, then a column filter).
  R is the distance to the k-th nearest training cell on the query's row or
  column, so the ball of radius R already holds k cells and no cell outside
  the box can be nearer; when neither line holds k cells the box covers the
  whole segment.
* Ties are broken by (squared distance, row, col), the mean of the k values
  is order independent (``stable_avg``).
* Random forests and gradient-boosted trees of all segments are grown in one
  job (see :mod:`vintage.operators.trees`).
"""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions import exact_sum, fixed, stable_avg
from vintage.operators.matrix import abs_rates, observed
from vintage.operators.trees import ordered_sum, predictions, search_predictions
from vintage.params import FOREST_TREES, MODEL_SEED, Params
from vintage.session import dealt, materialize

# measure -> (cell column, decimals of its values)
MATRIX_MEASURES = {"retention": ("retention_rate_abs_val", 4), "ltv": ("traditional_ltv", 1)}
# The model names in the reference's order; ties go to the first.
MODEL_ORDER = ("Random Forest", "Bayesian", "KNN")


def _index(df: DataFrame, seg: list[str], col: str, out: str) -> DataFrame:
    w = Window.partitionBy(*seg).orderBy(col) if seg else Window.orderBy(col)
    return df.select(*seg, col).distinct().withColumn(out, (F.dense_rank().over(w) - 1).cast("int"))


def matrix_cells(cells: DataFrame, measure: str, p: Params) -> DataFrame:
    """M4: observed cells of the measure with positional indices over the
    cohorts and periods that keep at least one value (T6)."""
    value, _ = MATRIX_MEASURES[measure]
    seg = list(p.segment_cols)
    obs = observed(abs_rates(cells), value, p)
    rows = _index(obs, seg, "cohort", "row_idx")
    cols = _index(obs, seg, "period_number", "col_idx")
    return (obs.join(rows, [*seg, "cohort"]).join(cols, [*seg, "period_number"])
            .select(*seg, "row_idx", "col_idx", "cohort", "period_number", "value"))


def missing_cells(cells: DataFrame, measure: str, p: Params, m: DataFrame | None = None) -> DataFrame:
    """M5: (row, col) positions of the matrix without a value. The grid is
    generated per segment by exploding the column range on each row (size
    bounded by months²), then observed positions are removed (anti join).
    ``m`` is the already indexed matrix when the caller has it."""
    seg = list(p.segment_cols)
    m = matrix_cells(cells, measure, p) if m is None else m
    rows = m.select(*seg, "row_idx", "cohort").distinct()
    cols = m.select(*seg, "col_idx", "period_number").distinct()
    if seg:
        ncol = cols.groupBy(*seg).agg(F.count(F.lit(1)).alias("_nc"))
        grid = rows.join(ncol, seg).select(*seg, "row_idx", "cohort",
                                           F.explode(F.sequence(F.lit(0), (F.col("_nc") - 1).cast("int"))).alias("col_idx"))
    else:
        nc = cols.agg(F.count(F.lit(1))).scalar()
        grid = rows.select("row_idx", "cohort",
                           F.explode(F.sequence(F.lit(0), (nc - 1).cast("int"))).alias("col_idx"))
    grid = grid.join(cols, [*seg, "col_idx"])
    return (grid.join(m, [*seg, "row_idx", "col_idx"], "left_anti")
            .select(*seg, "row_idx", "col_idx", "cohort", "period_number"))


def split(m: DataFrame, p: Params) -> DataFrame:
    """L1: deterministic 80/20 split on the cell position (independent of
    partitioning, reproducible in SQL): test when
    (row*31 + col*17 + seed) mod 5 == 0."""
    test = ((F.col("row_idx") * 31 + F.col("col_idx") * 17 + F.lit(p.split_seed)) % p.split_mod) == 0
    return m.withColumn("is_test", test)


def knn_regress(train: DataFrame, query: DataFrame, k: int, places: int,
                seg: tuple[str, ...] = ()) -> DataFrame:
    """L4: exact k-nearest-neighbour mean of ``value`` for each query cell
    (``seg`` + row_idx, col_idx); result adds ``prediction``.

    Each query gets its own search radius R: the distance to its k-th
    nearest training cell in its own row, or in its own column, whichever is
    smaller (those k cells lie in the ball of radius R, so the k nearest
    overall do too), or, when neither line holds k training cells, the
    radius whose box covers every training cell of the segment. One band
    join then collects the training cells in the box [r-R, r+R] x [c-R, c+R]
    (equi-join on the exploded row window, filter on the column), and the k
    best by (squared distance, row, col) are averaged. No loop and no cross
    join; each query's candidates are bounded by its box. Queries are few
    bytes and many candidates, so they are dealt out by number.
    """
    seg = list(seg)
    qk = [*seg, "row_idx", "col_idx"]
    r, c = F.col("row_idx"), F.col("col_idx")
    t = materialize(train.select(*seg, F.col("row_idx").alias("_tr"), F.col("col_idx").alias("_tc"), "value"))
    q = dealt(query.select(*qk), *qk).distinct()  # the other way round, the planner would leave out the repartition

    def kth_on_line(line: str, other: str, t_line: str, t_other: str, out: str) -> DataFrame:
        d = (q.join(t.withColumnRenamed(t_line, line), [*seg, line])
             .select(*qk, F.abs(F.col(t_other) - F.col(other)).alias("_d")))
        w = Window.partitionBy(*qk).orderBy("_d")
        return (d.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == k)
                .select(*qk, F.col("_d").alias(out)))

    ext = t.groupBy(*seg).agg(F.min("_tr").alias("_r0"), F.max("_tr").alias("_r1"),
                              F.min("_tc").alias("_c0"), F.max("_tc").alias("_c1"))
    if seg:
        qe = q.join(ext, seg, "left")
    else:
        qe = q.select(*qk, *[ext.select(x).scalar().alias(x) for x in ("_r0", "_r1", "_c0", "_c1")])
    cover = F.greatest(r - F.col("_r0"), F.col("_r1") - r, c - F.col("_c0"), F.col("_c1") - c)
    radius = (qe.select(*qk, cover.alias("_cover"))
              .join(kth_on_line("row_idx", "col_idx", "_tr", "_tc", "_rb"), qk, "left")
              .join(kth_on_line("col_idx", "row_idx", "_tc", "_tr", "_cb"), qk, "left")
              .select(*qk, F.least("_rb", "_cb", "_cover").alias("_R"))
              .where(F.col("_R").isNotNull()))
    band = dealt(radius, *qk).select(*qk, "_R", F.explode(F.sequence(r - F.col("_R"), r + F.col("_R"))).alias("_tr"))
    cand = (band.join(t, [*seg, "_tr"])
            .where(F.abs(F.col("_tc") - c) <= F.col("_R"))
            .withColumn("_d2", (F.col("_tr") - r) * (F.col("_tr") - r) + (F.col("_tc") - c) * (F.col("_tc") - c)))
    order = Window.partitionBy(*qk).orderBy("_d2", "_tr", "_tc")
    pred = (cand.withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= k)
            .groupBy(*qk).agg(stable_avg("value", places).alias("prediction")))
    return query.join(pred, qk, "left")


def r2(pred: DataFrame, seg: tuple[str, ...] = (), y: str = "value",
       yhat: str = "prediction") -> DataFrame:
    """Coefficient of determination 1 - SS_res / SS_tot per segment, from
    sums that don't depend on the order of rows (:func:`exact_sum`)."""
    seg = list(seg)
    pred = pred.where(F.col(yhat).isNotNull())
    mean = pred.groupBy(*seg).agg((exact_sum(y) / F.count(F.lit(1))).alias("_ybar"))
    if seg:
        j = pred.join(mean, seg)
    else:
        j = pred.withColumn("_ybar", mean.select("_ybar").scalar())
    j = j.select(*seg, ((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat))).alias("_res"),
                 ((F.col(y) - F.col("_ybar")) * (F.col(y) - F.col("_ybar"))).alias("_tot"))
    return (j.groupBy(*seg).agg(exact_sum("_res").alias("_ssr"), exact_sum("_tot").alias("_sst"))
            .select(*seg, (F.lit(1.0) - F.col("_ssr") / F.col("_sst")).alias("r2")))


def knn_test_predictions(cells: DataFrame, measure: str, p: Params) -> DataFrame:
    """k-NN trained on the training side, predicting the test side."""
    _, places = MATRIX_MEASURES[measure]
    s = materialize(split(matrix_cells(cells, measure, p), p))
    train = s.where(~F.col("is_test"))
    test = s.where(F.col("is_test"))
    return knn_regress(train, test, p.knn_k, places, p.segment_cols)


def knn_filled(cells: DataFrame, measure: str, p: Params) -> DataFrame:
    """M6 + L11 + K22 with k-NN: observed cells and k-NN predictions for the
    empty cells (model trained on the training side only, as the reference
    does), flagged ``is_predicted``."""
    _, places = MATRIX_MEASURES[measure]
    s = materialize(split(matrix_cells(cells, measure, p), p))
    train = s.where(~F.col("is_test"))
    miss = materialize(missing_cells(cells, measure, p, s))
    pred = knn_regress(train, miss, p.knn_k, places, p.segment_cols)
    return _fill(s.drop("is_test"), pred, p)


def _fill(obs: DataFrame, pred: DataFrame, p: Params) -> DataFrame:
    """Observed cells and predictions in one matrix, with the reference's
    two-decimal annotation (K22: predicted cells are the ones drawn in red)."""
    seg = list(p.segment_cols)
    cols = [*seg, "row_idx", "col_idx", "cohort", "period_number", "value", "is_predicted"]
    out = (obs.withColumn("is_predicted", F.lit(False)).select(*cols)
           .unionByName(pred.select(*seg, "row_idx", "col_idx", "cohort", "period_number",
                                    F.col("prediction").alias("value"),
                                    F.lit(True).alias("is_predicted"))))
    v = F.col("value")
    return out.withColumn("label", F.when(v.isNotNull(), fixed(v, 2)))


# ---------------------------------------------------------------- trees
def test_side(m: DataFrame, p: Params) -> DataFrame:
    """Positions and values of the test side of a split matrix."""
    return m.where(F.col("is_test")).select(*p.segment_cols, "row_idx", "col_idx", "value")


def all_predictions(s: DataFrame, query: DataFrame, places: int, p: Params) -> DataFrame:
    """Forest, boosted trees and k-NN of every segment, learned from the
    training side of ``s``: (seg, row_idx, col_idx, model, prediction) for the
    positions ``query``. All segments, trees and models are one job."""
    seg = list(p.segment_cols)
    where = [*seg, "row_idx", "col_idx"]
    train = s.where(~F.col("is_test")).select(*where, "value")
    cells = (train.withColumn("is_query", F.lit(False))
             .unionByName(query.select(*where, F.lit(None).cast("double").alias("value"), F.lit(True).alias("is_query"))))
    trees = predictions(cells, seg, places, FOREST_TREES, MODEL_SEED)
    knn = knn_regress(train, query.select(*where), p.knn_k, places, p.segment_cols)
    return materialize(trees.unionByName(knn.where(F.col("prediction").isNotNull())
                                         .select(*where, F.lit("KNN").alias("model"), "prediction")))


def scored(preds: DataFrame, test: DataFrame, p: Params) -> DataFrame:
    """R² of each model on the test side and ``is_best`` (highest,
    ties to the earlier model in the reference's order)."""
    seg = list(p.segment_cols)
    j = _same_cell(preds.select(*seg, "row_idx", "col_idx", "model", "prediction"), test, p, "inner")
    scores = r2(j, (*seg, "model"))
    rank = F.create_map(*[x for i, m in enumerate(MODEL_ORDER) for x in (F.lit(m), F.lit(i))])
    w = Window.partitionBy(*seg).orderBy(F.col("r2").desc_nulls_last(), rank[F.col("model")])
    return scores.withColumn("is_best", F.row_number().over(w) == 1).select(*seg, "model", "r2", "is_best")


def _same_cell(left: DataFrame, right: DataFrame, p: Params, how: str) -> DataFrame:
    """Join on segment and position."""
    return left.join(right, [*p.segment_cols, "row_idx", "col_idx"], how)


def test_predictions(cells: DataFrame, measure: str, p: Params) -> DataFrame:
    """Value and prediction of each model for each test cell."""
    _, places = MATRIX_MEASURES[measure]
    s = materialize(split(matrix_cells(cells, measure, p), p))
    test = test_side(s, p)
    return _same_cell(all_predictions(s, test, places, p), test, p, "inner")


def model_scores(cells: DataFrame, measure: str, p: Params) -> DataFrame:
    """One row per segment and model with its test R² and ``is_best``."""
    _, places = MATRIX_MEASURES[measure]
    s = materialize(split(matrix_cells(cells, measure, p), p))
    test = test_side(s, p)
    return scored(all_predictions(s, test, places, p), test, p)


def best_filled(cells: DataFrame, measure: str, p: Params) -> DataFrame:
    """Empty cells filled by the best model of the segment (trained on
    the training side only, not refitted), observed cells kept, predictions
    flagged. Test and empty cells are predicted together."""
    _, places = MATRIX_MEASURES[measure]
    seg = list(p.segment_cols)
    s = materialize(split(matrix_cells(cells, measure, p), p))
    miss = materialize(missing_cells(cells, measure, p, s))
    test = test_side(s, p)
    where = [*seg, "row_idx", "col_idx"]
    preds = all_predictions(s, test.select(*where).unionByName(miss.select(*where)), places, p)
    best = scored(preds, test, p).where("is_best").select(*seg, "model")
    chosen = preds.join(best, [*seg, "model"], "left_semi").select(*where, "prediction")
    return _fill(s.drop("is_test"), _same_cell(miss, chosen, p, "left"), p)


# ---------------------------------------------------------------- random search
SEARCH_SPACE = {
    # The reference's search space.
    "n_estimators": [100, 200, 300, 400, 500],
    "max_depth": [10, 20, 30, None],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["auto", "sqrt", "log2"],
}


def search_draws(n_iter: int = 100, seed: int = 42) -> list[dict]:
    """A seeded draw without replacement from the search space."""
    combos = [dict(zip(SEARCH_SPACE, v, strict=True)) for v in itertools.product(*SEARCH_SPACE.values())]
    return random.Random(seed).sample(combos, min(n_iter, len(combos)))


def with_fold(m: DataFrame, folds: int, seed: int) -> DataFrame:
    """The fold of a training cell, by its position (as `split`)."""
    return m.withColumn("fold", F.pmod(F.col("row_idx") * 13 + F.col("col_idx") * 7 + F.lit(seed), F.lit(folds)).cast("int"))


def random_search(cells: DataFrame, measure: str, p: Params, n_iter: int = 100,
                  folds: int = 3, seed: int = 42) -> DataFrame:
    """``n_iter`` forest settings drawn from the search space, each
    scored by ``folds``-fold cross-validated R² on the training side: every
    setting with its mean R² and ``is_best`` (per segment; ties to the earlier
    draw). As in the reference the result is reported only: the fill keeps the
    model chosen by ``model_scores``."""
    _, places = MATRIX_MEASURES[measure]
    seg = list(p.segment_cols)
    draws = search_draws(n_iter, seed)
    s = materialize(split(matrix_cells(cells, measure, p), p))
    train = with_fold(s.where(~F.col("is_test")), folds, seed).select(*seg, "row_idx", "col_idx", "value", "fold")
    preds = search_predictions(train, draws, seg, places, folds, seed)
    j = _same_cell(preds.drop("fold"), train, p, "inner")
    per = r2(j, (*seg, "draw", "fold"))
    mean = per.groupBy(*seg, "draw").agg((ordered_sum("fold", "r2") / F.count(F.lit(1))).alias("cv_r2"))
    settings = cells.sparkSession.createDataFrame(
        [(i, *d.values()) for i, d in enumerate(draws)],
        "draw int, n_estimators int, max_depth int, min_samples_split int, min_samples_leaf int, max_features string")
    w = Window.partitionBy(*seg).orderBy(F.col("cv_r2").desc_nulls_last(), "draw")
    return (mean.join(F.broadcast(settings), "draw")  # as many rows as draws
            .withColumn("is_best", F.row_number().over(w) == 1)
            .select(*seg, "draw", *SEARCH_SPACE, "cv_r2", "is_best"))
