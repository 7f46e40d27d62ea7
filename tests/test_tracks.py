"""Samples along the tracks of baselines: tasks by the number of samples, sums row by row."""

import numpy as np
from fringeworks.operators import visibility
from pyspark.sql import functions as F


def samples(spark, n=4000):
    r = np.random.default_rng(5)
    rows = [(int(k), float(r.integers(0, 40)), int(r.integers(0, 4)), int(r.integers(0, 4)), 1, *map(float, 40 * r.integers(-9, 9, 3)), 1.1e9, 1.0, 2.0, 1.0, bool(k % 13 == 0)) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, time double, ant1 int, ant2 int, chan int, u double, v double, w double, freq double, re double, im double, weight double, flag boolean")


def test_tasks_grow_with_the_samples(spark, monkeypatch):
    monkeypatch.setattr(visibility, "TRACKED", 200)
    vis = samples(spark)
    good = vis.filter("not flag").count()
    out = visibility.average_baselines(vis, 0.9, 1e-3)
    assert out.rdd.getNumPartitions() == -(-good // 200)
    assert visibility.tracks(vis).rdd.getNumPartitions() == -(-good // 200)
    assert out.agg(F.sum("samples")).first()[0] == good


def test_path_adds_row_by_row(spark):
    """Two samples of one time and id each add their own step, as rows do in SQL."""
    vis = samples(spark, 400).withColumn("row_id", F.lit(0)).withColumn("time", F.floor(F.col("time") / 8).cast("double")).withColumn("ant1", F.lit(1)).withColumn("ant2", F.lit(2))
    out = visibility.average_baselines(vis, 0.9, 1e-3)
    assert out.agg(F.sum("samples")).first()[0] == vis.filter("not flag").count()
    assert out.count() > 5  # more bins than there are times
