import numpy as np

from pyspark.sql import functions as F

from vintage.operators.impute import knn_regress, r2


def brute(train, queries, k):
    out = {}
    for (qs, qr, qc) in queries:
        cand = sorted(((tr - qr) ** 2 + (tc - qc) ** 2, tr, tc, v) for (ts, tr, tc, v) in train if ts == qs)
        vals = [v for *_, v in cand[:k]]
        out[(qs, qr, qc)] = (sum(round(v * 10) for v in vals) / (len(vals) * 10.0)) if vals else None
    return out


def test_knn_exact_against_brute_force(spark):
    rng = np.random.default_rng(11)
    train, queries = [], []
    for s in ("s1", "s2"):
        n = 14
        for r in range(n):
            for c in range(n):
                if r + c < n and rng.random() < 0.8:
                    train.append((s, r, c, float(np.round(rng.normal(50, 20), 1))))
                elif r + c >= n - 2:
                    queries.append((s, r, c))
    tdf = spark.createDataFrame(train, "seg string, row_idx int, col_idx int, value double")
    qdf = spark.createDataFrame(queries, "seg string, row_idx int, col_idx int")
    got = {(r.seg, r.row_idx, r.col_idx): r.prediction
           for r in knn_regress(tdf, qdf, 5, 1, ("seg",)).collect()}
    exp = brute(train, queries, 5)
    assert got.keys() == exp.keys()
    for key in exp:
        assert abs(got[key] - exp[key]) < 1e-9, key


def test_three_by_three_matrix(spark):
    obs = [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0), (2, 0, 6.0)]
    tdf = spark.createDataFrame(obs, "row_idx int, col_idx int, value double")
    qdf = spark.createDataFrame([(1, 2), (2, 1), (2, 2)], "row_idx int, col_idx int")
    got = {(r.row_idx, r.col_idx): r.prediction for r in knn_regress(tdf, qdf, 5, 1).collect()}
    exp = brute([(None, r, c, v) for r, c, v in obs], [(None, 1, 2), (None, 2, 1), (None, 2, 2)], 5)
    assert got == {k[1:]: v for k, v in exp.items()}


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5), (4.0, 4.5)], "value double, prediction double")
    y = np.array([1.0, 2.0, 3.0, 4.0]); p = np.array([1.5, 2.0, 2.5, 4.5])
    exp = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(r2(df).first().r2 - exp) < 1e-12
    assert r2(df.withColumn("prediction", F.col("value"))).first().r2 == 1.0


def test_segmented_fill_equals_per_segment_runs(spark):
    from conftest import SF
    from vintage.operators import cells as C
    from vintage.operators.impute import knn_filled
    from vintage.params import FIXTURE_PARAMS
    from vintage.session import materialize
    from vintage.sources import transactions_from_tables

    p_seg = FIXTURE_PARAMS.with_(country=None, segment_cols=("country",))
    cells = materialize(C.cohort_cells(transactions_from_tables(spark, SF), p_seg))
    seg = knn_filled(cells, "retention", p_seg)
    countries = [r.country for r in cells.select("country").distinct().collect()][:3]
    for country in countries:
        one = cells.where(F.col("country") == country).drop("country")
        solo = knn_filled(one, "retention", FIXTURE_PARAMS.with_(country=None))
        part = seg.where(F.col("country") == country).drop("country")
        assert part.exceptAll(solo.select(*part.columns)).count() == 0
        assert solo.select(*part.columns).exceptAll(part).count() == 0


def test_queries_are_dealt_out_by_number(spark):
    """Candidates are many where queries are few bytes: with all joins broadcast the run-time planner would bring them to one task."""
    train = [("s", r, c, float(r * c % 7)) for r in range(30) for c in range(30 - r)]
    queries = [("s", r, c) for r in range(30) for c in range(30 - r, 30)]
    tdf, qdf = spark.createDataFrame(train, "seg string, row_idx int, col_idx int, value double"), spark.createDataFrame(queries, "seg string, row_idx int, col_idx int")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "10m")
    try:
        got = knn_regress(tdf, qdf, 5, 1, ("seg",)).select("*", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set(key, before)
    assert {(x.seg, x.row_idx, x.col_idx): x.prediction for x in got} == brute(train, queries, 5)
    assert len({x.part for x in got}) > 1
