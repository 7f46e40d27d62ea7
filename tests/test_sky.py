"""Grids on the sky and regions, at their edges."""

import numpy as np
import pytest
from fringeworks.operators import sky
from pyspark.sql import functions as F


def grid(spark, values):
    rows = [(0, x, y, float(v)) for (x, y), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "band int, x int, y int, value double")


def dense(df, column="value", shape=(6, 6)):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.x, r.y] = r[column]
    return out


def field(spark, *row):
    return spark.createDataFrame([(0, *map(float, row))], "band int, ra_in double, dec_in double, ra double, dec double")


def test_projection_there_and_back(spark):
    """Also next to the pole, and over the turn of right ascension."""
    rows = [(l / 10, m / 10, ra, dec) for l in range(-6, 7, 3) for m in range(-6, 7, 3) for ra, dec in ((0.0, 0.0), (6.2, -0.7), (3.0, 1.56))]
    points = spark.createDataFrame(rows, "l double, m double, ra0 double, dec0 double")
    ra, dec = sky.to_sky(F.col("l"), F.col("m"), F.col("ra0"), F.col("dec0"))
    l, m = sky.from_sky(ra, dec, F.col("ra0"), F.col("dec0"))
    far = points.select((F.abs(l - F.col("l")) + F.abs(m - F.col("m"))).alias("off")).agg(F.max("off"), F.count("off")).first()
    assert far[0] < 1e-9 and far[1] == len(rows)
    beyond = points.select(*(c.alias(n) for c, n in zip(sky.to_sky(F.lit(0.9), F.lit(0.9), F.lit(0.0), F.lit(0.0)), "ab"))).first()
    assert beyond.a is None and beyond.b is None


def test_a_grid_on_itself_and_shifted(spark):
    """The same grid gives the image back with its edge; one shifted by whole pixels moves it; missing and NaN pixels are undefined."""
    v = np.random.default_rng(0).normal(size=(6, 6))
    rows = grid(spark, v)
    same = sky.reproject(rows, field(spark, 1.0, -0.4, 1.0, -0.4), ["band"], 6, 6, 1e-3, 1e-3, (3, 3))
    assert np.allclose(dense(same), v) and dense(same, "defined").all()
    moved = dense(sky.reproject(rows, field(spark, 1.0, -0.4, 1.0, -0.4), ["band"], 6, 6, 1e-3, 1e-3, (5, 3)))
    assert np.allclose(moved[:4], v[2:]) and not moved[4:].any()
    holes = rows.filter("not (x = 1 and y = 1)").withColumn("value", F.when(F.expr("x = 4 and y = 4"), float("nan")).otherwise(F.col("value")))
    half = sky.reproject(holes, field(spark, 1.0, -0.4, 1.0, -0.4), ["band"], 6, 6, 1e-3, 1e-3, (3.5, 3))
    value, known = dense(half), dense(half, "defined")
    want = np.zeros((6, 6))
    want[:5] = (v[:-1] + v[1:]) / 2
    off = [(5, y) for y in range(6)] + [(0, 1), (1, 1), (3, 4), (4, 4)]
    for at in off:
        want[at] = 0
    assert np.allclose(value, want) and {tuple(map(int, p)) for p in np.argwhere(known == 0)} == set(off)


def test_other_side_of_the_sky_is_undefined(spark):
    rows = grid(spark, np.ones((6, 6)))
    out = sky.reproject(rows, field(spark, 0.0, 0.0, np.pi, 0.0), ["band"], 6, 6, 1e-3, 1e-3, (3, 3))
    assert out.count() == 36 and not dense(out).any() and not dense(out, "defined").any()
    assert sky.reproject(rows.limit(0), field(spark, 0.0, 0.0, 0.0, 0.0), ["band"], 2, 2, 1e-3, 1e-3, (3, 3)).filter("defined").count() == 0


def inside(points, x, y):
    """Crossings to the right."""
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return odd


def test_polygons_like_the_plain_rule(spark):
    """Whole corners, a bow tie, one beyond the frame on all sides, a line, a point, and random ones; null vertices are left out."""
    rng = np.random.default_rng(3)
    shapes = [[(1, 1), (6, 1), (6, 5), (1, 5)], [(0, 0), (8, 8), (8, 0), (0, 8)], [(-9, -9), (40, -9), (40, 40), (-9, 40)], [(2, 2), (7, 7)], [(3, 3)]]
    shapes += [[tuple(map(float, p)) for p in rng.uniform(-3, 15, (n, 2))] for n in (3, 4, 7, 12)]
    rows = [(k, i, float(x), float(y)) for k, s in enumerate(shapes) for i, (x, y) in enumerate(s)] + [(0, 9, None, 3.0), (0, 10, float("nan"), 1.0), (None, 0, 1.0, 1.0)]
    mask = sky.masks(sky.spans(spark.createDataFrame(rows, "region int, i int, x double, y double"), 12, 10))
    got = {tuple(r) for r in mask.collect()}
    want = {(k, x, y) for k, s in enumerate(shapes) for x in range(12) for y in range(10) if inside(s, x, y)}
    assert got == want and {k for k, _, _ in want} >= {0, 1, 2, 5}


def test_circles_and_overlaps(spark):
    circles = [(0, 4.0, 4.0, 2.0), (1, 20.0, 4.5, 1.5), (2, 0.0, 0.0, 3.0), (3, 5.0, 5.0, 0.0), (4, 6.5, 4.0, 1.0)]
    mask = sky.masks(sky.circle_spans(spark.createDataFrame(circles, "region int, x double, y double, radius double"), 24, 12)).cache()
    want = {(k, x, y) for k, cx, cy, r in circles for x in range(24) for y in range(12) if (x - cx) ** 2 + (y - cy) ** 2 < r * r}
    assert {tuple(r) for r in mask.collect()} == want
    assert sky.overlaps(mask).count() == 0
    image = spark.range(24 * 12).select((F.col("id") % 24).cast("int").alias("x"), F.floor(F.col("id") / 24).cast("int").alias("y"), F.lit(1.0).alias("value"))
    parts = {r.region: r.n for r in sky.split(image, mask).groupBy("region").agg(F.count("*").alias("n")).collect()}
    assert sum(parts.values()) == 24 * 12 and parts[0] == 9 and parts[None] == 24 * 12 - len(want)
    doubled = mask.union(mask.filter("region = 0").withColumn("region", F.lit(9)))
    assert sky.overlaps(doubled).count() == 9
    with pytest.raises(ValueError, match="overlap"):
        sky.split(image, doubled)


def test_points_to_pixels(spark):
    points = spark.createDataFrame([(30.0, -10.0, "a"), (210.0, 10.0, "b")], "ra_deg double, dec_deg double, name string")
    got = {r.name: (r.x, r.y) for r in sky.to_pixels(points, 30.0, -10.0, 16, 12, 1e-4).collect()}
    assert got["a"] == pytest.approx((8, 6)) and got["b"] == (None, None)
