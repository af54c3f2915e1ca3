import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintage.operators.ranking import row_number_within, running_sum


def test_row_number_matches_window_with_hot_group(spark):
    random.seed(5)
    rows = set()
    while len(rows) < 6000:
        g = "hot" if random.random() < 0.6 else random.choice(["a", "b", None])
        rows.add((g, random.randint(0, 50), f"k{random.randint(0, 10**6)}"))
    df = spark.createDataFrame(sorted(rows, key=str), "g string, o1 int, o2 string")
    ours = row_number_within(df, ["g"], ["o1", "o2"], slices=7)
    ref = df.withColumn("RN", F.row_number().over(Window.partitionBy("g").orderBy("o1", "o2")))
    assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0


def test_weighted_running_sum(spark):
    df = spark.createDataFrame([("x", 1, 3), ("x", 2, 4), ("x", 5, 1), ("y", 1, 2)], "g string, v int, w int")
    got = {(r.g, r.v): r._cum for r in running_sum(df, ["g"], ["v"], weight="w", slices=3).collect()}
    assert got == {("x", 1): 3, ("x", 2): 7, ("x", 5): 8, ("y", 1): 2}
