"""The gridder and degridder with planes of w against exact sums, on fields where w matters."""

import numpy as np
import pytest
from fringeworks.operators import imaging, wgrid
from fringeworks.plans.tables import stored
from pyspark.sql import functions as F

VIS = "band int, u double, v double, w double, freq double, re double, im double, weight double, flag boolean"


def samples(spark, n=300, far=1.0):
    r = np.random.default_rng(0).normal(size=(n, 6)) * np.array([60 * far, 60 * far, 40, 1, 1, 1])
    rows = [(k % 2, *map(float, x[:3]), 1.4e9 - 1e8 * (k % 3), float(x[3]), float(x[4]), float(abs(x[5])), k % 17 == 0) for k, x in enumerate(r)]
    return spark.createDataFrame(rows, VIS).repartition(3)


#: Images that are no multiple of a tile, tiles narrower and wider than the kernel, and a field too small for w.
SHAPES = [(20, 14, 8e-3, 8, 16), (20, 14, 8e-3, 8, 8), (21, 9, 5e-3, 6, 4), (16, 16, 1e-4, 8, 64)]


def values(df, *keys):
    return {tuple(r[k] for k in keys): r.value for r in df.collect()}


@pytest.mark.parametrize(("nx", "ny", "cell", "width", "tile"), SHAPES)
def test_image(spark, nx, ny, cell, width, tile):
    vis = samples(spark)
    got = values(wgrid.image(vis, wgrid.Geometry(nx, ny, cell, width, tile), ["band"]), "band", "x", "y")
    want = values(imaging.direct_image(vis, nx, ny, cell, ["band"]), "band", "x", "y")
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) <= 1e-5 * sum(r.weight for r in vis.collect())


def test_samples_beyond_the_grid_come_round(spark):
    """Pixels are whole cells apart, so a sample far out gives what the exact sum gives."""
    vis = samples(spark, far=20.0)
    got = values(wgrid.image(vis, wgrid.Geometry(16, 16, 8e-3, 8, 8)), "x", "y")
    want = values(imaging.direct_image(vis, 16, 16, 8e-3), "x", "y")
    assert max(abs(got[k] - want[k]) for k in want) <= 1e-4


@pytest.mark.parametrize(("nx", "ny", "cell", "width", "tile"), SHAPES)
def test_degridding(spark, nx, ny, cell, width, tile):
    r = np.random.default_rng(1)
    pixels = [(int(x), int(y), float(v)) for x, y, v in zip(r.integers(0, nx, 40), r.integers(0, ny, 40), r.normal(size=40))]
    model, vis = spark.createDataFrame(pixels, "x int, y int, value double"), samples(spark)
    key = lambda x: (x.u, x.v, x.w)
    got = sorted(wgrid.degridded(vis, model, wgrid.Geometry(nx, ny, cell, width, tile)).collect(), key=key)
    want = sorted(brute(vis, pixels, nx, ny, cell), key=lambda x: x[0])
    assert len(got) == len(want)
    assert max(abs(g.p_re + 1j * g.p_im - w[1]) for g, w in zip(got, want)) <= 1e-5 * sum(abs(v) for *_, v in pixels)


def brute(vis, pixels, nx, ny, cell):
    for s in vis.collect():
        total = 0
        for x, y, v in pixels:
            l, m = (x - nx // 2) * cell, (y - ny // 2) * cell
            phase = 2 * np.pi * s.freq / 299792458.0 * (s.u * l - s.v * m - s.w * (np.sqrt(1 - l * l - m * m) - 1))
            total += v * np.exp(-1j * phase)
        yield (s.u, s.v, s.w), total


def test_nothing_to_grid(spark):
    empty, g = spark.createDataFrame([], VIS), wgrid.Geometry(8, 8, 1e-3, 8, 16)
    model = spark.createDataFrame([(4, 4, 1.0)], "x int, y int, value double")
    assert wgrid.image(empty, g, ["band"]).count() == 0 and wgrid.degridded(empty, model, g).count() == 0
    no_model = spark.createDataFrame([], "x int, y int, value double")
    assert {(r.p_re, r.p_im) for r in wgrid.degridded(samples(spark, 5), no_model, g).collect()} == {(0.0, 0.0)}


def shuffled(df):
    """Rows that the plan of a result, once it has run, has put through its exchanges."""
    df.collect()
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
        elif plan.getClass().getSimpleName() == "ShuffleExchangeExec":
            out += plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_degridding_leaves_samples_where_they_are(spark, monkeypatch):
    """Samples ask for one piece of the grid, not for a tile on each plane; in many pieces the result is the same."""
    vis, g = stored(samples(spark, 2000).drop("re", "im"), "vis"), wgrid.Geometry(16, 16, 0.01, 12, 16)
    model = spark.createDataFrame([(4, 4, 1.0), (9, 3, -2.0)], "x int, y int, value double")
    out = wgrid.degridded(vis, model, g)
    assert shuffled(out) == 0
    monkeypatch.setattr(wgrid, "PIECES", 0)
    key = lambda x: (x.u, x.v, x.w)
    same = sorted(wgrid.degridded(vis, model, g).collect(), key=key)
    assert len(same) == 2000 and all(abs(a.p_re - b.p_re) < 1e-12 and abs(a.p_im - b.p_im) < 1e-12 for a, b in zip(same, sorted(out.collect(), key=key)))


def test_samples_without_a_place_have_no_visibility(spark):
    vis = samples(spark, 20).withColumn("u", F.when(F.col("v") > 0, F.col("u")))
    model = spark.createDataFrame([(4, 4, 1.0)], "x int, y int, value double")
    got = wgrid.degridded(vis, model, wgrid.Geometry(8, 8, 8e-3, 8, 8)).collect()
    assert len(got) == 20 and all((r.p_re == 0 and r.p_im == 0) == (r.u is None) for r in got)
