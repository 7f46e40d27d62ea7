"""Beams, partitions at a glance and blocks of time: edges that the registered queries do not reach."""

import math

import pytest
from fringeworks.operators import beams
from pyspark.sql import functions as F


def test_cosine_beam(spark):
    """1 at the centre, a half at half the width, and finite where both parts of the ratio vanish."""
    half = beams.WIDTH_AT_1GHZ / 2
    pole = 0.5 / beams.SCALE * beams.WIDTH_AT_1GHZ
    table = spark.createDataFrame([(0.0,), (half,), (pole,), (pole + 1e-7,), (None,)], "l double")
    got = [r[0] for r in table.select(beams.cosine_beam(F.col("l"), F.lit(0.0), F.lit(1e9))).collect()]
    assert got[0] == 1 and got[1] == pytest.approx(0.5, abs=1e-3) and got[2] == pytest.approx((math.pi / 4) ** 2)
    assert got[3] == pytest.approx(got[2], abs=1e-5) and got[4] is None


def test_planes(spark):
    """On a plane, between two, outside and null; columns of clashing names are ignored."""
    beam = spark.createDataFrame([(1.0, 0, 0, 10.0, "z"), (3.0, 0, 0, 30.0, "z"), (3.0, 1, 0, 5.0, "z"), (None, 0, 0, 7.0, "z")], "freq double, x int, y int, value double, knots string")
    targets = spark.createDataFrame([(1, 1.0), (2, 2.5), (2, 2.5), (3, 3.0), (4, 0.5), (5, 3.5), (6, None)], "channel int, freq double").withColumn("value", F.lit("v"))
    got = sorted(tuple(r) for r in beams.at_frequencies(beam, targets, ["channel"]).collect())
    assert got == [(1, 0, 0, 10.0), (2, 0, 0, 25.0), (2, 0, 0, 25.0), (3, 0, 0, 30.0), (3, 1, 0, 5.0)]
    assert beams.at_frequencies(beam.limit(0), targets, ["channel"]).count() == 0


def test_divided(spark):
    images = spark.createDataFrame([(0, 3.0), (1, 3.0), (2, 3.0)], "x int, value double")
    beam = spark.createDataFrame([(0, 0.5), (1, 0.0)], "x int, beam double")
    got = {r.x: r.value for r in beams.divided(images, beam, ["x"], 0.0).collect()}
    assert got == {0: 6.0, 1: 0.0, 2: 3.0}


def test_blocks_of_a_stream_are_those_of_the_table(spark, tmp_path):
    from fringeworks.streaming import block_means

    rows = [(k, f"2024-01-01 0{h}:{m}0:00", v, w) for k, h, m, v, w in [(1, 0, 0, 1.0, 1.0), (1, 0, 5, 3.0, 3.0), (1, 1, 0, 5.0, 0.0), (None, 0, 1, 2.0, 1.0), (1, 0, 2, None, 1.0), (2, 5, 0, 1.0, 1.0), (2, 9, 0, 1.0, 1.0)]]
    events = spark.createDataFrame(rows, "k int, ts string, value double, weight double").withColumn("ts", F.to_timestamp("ts")).withColumn("start", F.lit("clash"))
    table = {(r.k, r.start): (r.value, r.weight, r.n, r.rms) for r in block_means(events, ["k"], "1 hour").collect()}
    assert sorted(table.values(), key=repr) == sorted([(2.5, 4.0, 2, 1.0), (None, 0.0, 1, 0.0), (2.0, 1.0, 1, 0.0), (1.0, 1.0, 1, 0.0), (1.0, 1.0, 1, 0.0)], key=repr)
    events.write.parquet(f"{tmp_path}/in")
    stream = block_means(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), ["k"], "1 hour", "0 seconds")
    query = stream.writeStream.format("memory").queryName("blocks").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.k, r.start): (r.value, r.weight, r.n, r.rms) for r in spark.table("blocks").collect()}
    assert got.items() <= table.items() and len(got) == len(table) - 1  # the last block is still open
