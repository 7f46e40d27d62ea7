"""Dirty images, PSFs and residuals of one scan against sums over every sample, in narrow and in wide fields."""

import numpy as np
import pytest
from fringeworks.operators import imaging
from pyspark.sql import functions as F


def samples(spark, n=300):
    r = np.random.default_rng(3).normal(size=(n, 6)) * np.array([60, 60, 40, 1, 1, 1])
    rows = [(k % 2, *map(float, x[:3]), 1.4e9 - 1e8 * (k % 3), float(x[3]), float(x[4]), float(abs(x[5])), k % 17 == 0) for k, x in enumerate(r)]
    return spark.createDataFrame(rows, "band int, u double, v double, w double, freq double, re double, im double, weight double, flag boolean").repartition(3)


def values(df):
    return {(r.band, r.x, r.y): r.value for r in df.collect()}


@pytest.mark.parametrize(("nx", "ny", "cell"), [(6, 5, 1e-4), (6, 5, 4e-3), (6, 4, 2e-2)])
def test_products_are_the_sums_of_every_sample(spark, nx, ny, cell):
    vis, pixels = samples(spark), [(1, 2, 3.0), (4, 1, -1.0)]
    model = spark.createDataFrame(pixels, "x int, y int, value double")
    # columns that no product uses stay out of the tasks, of whatever type they are
    out = imaging.data_products(vis.withColumn("more", F.expr("make_interval(1)")), nx, ny, cell, ["band"], model).cache()
    over = lambda image: values(imaging.normalised(image, imaging.weight_sums(vis, ["band"]), ["band"]))
    wants = {"dirty": imaging.direct_image(vis, nx, ny, cell, ["band"]), "psf": imaging.direct_image(vis, 2 * nx, 2 * ny, cell, ["band"], value="psf"), "residual": imaging.residual(vis, model, nx, ny, cell, ["band"])}
    for product, want in wants.items():
        got, want = values(out.filter(F.col("product") == product)), over(want)
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) <= 1e-12


@pytest.mark.parametrize("turn", [1e-6, 1e-3, 0.1, 1.0])
def test_powers_give_all_digits(turn):
    series = sum((1j * turn) ** j / np.prod(np.arange(1.0, j + 1)) for j in range(imaging._powers(turn)))
    assert abs(series - np.exp(1j * turn)) <= 4e-16
