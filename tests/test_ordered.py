"""Bucketed running values equal the plain window, also for one very long group."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cubeloom.plans import ordered
from cubeloom.plans.ordered import dense_index, row_numbers, running


def _data(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 4)}", i, rnd.choice([None, 1, 2, 5])) for i in range(500)]
    return spark.createDataFrame(rows, "k string, pos bigint, v int")


def test_running_equals_window(spark, rows, monkeypatch):
    df = _data(spark)
    for inclusive, end, depth in ((True, 0, 1), (False, -1, 1), (True, 0, 2), (False, -1, 2)):
        monkeypatch.setattr(ordered, "BUCKET_ROWS", 5)
        got = running(
            df, ["k"], ["pos"], F.floor(F.col("pos") / 7), sums={"s": F.col("v")}, lasts={"l": F.col("v")}, inclusive=inclusive, depth=depth
        )
        w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, end)
        want = df.select(
            "*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.last("v", ignorenulls=True).over(w).alias("l")
        )
        assert rows(got) == rows(want)


def test_row_numbers_and_dense_index(spark, rows):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("pos")
    assert rows(row_numbers(df, ["k"], "pos", "n")) == rows(df.withColumn("n", F.row_number().over(w).cast("bigint")))
    numbered = dense_index(df, "pos", "i", buckets=16).collect()
    assert sorted(r.i for r in numbered) == list(range(500))
    assert len({r.pos for r in numbered}) == 500
