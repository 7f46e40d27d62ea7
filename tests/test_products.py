"""Stokes products, wavelets, models and bookkeeping against numpy."""

import numpy as np
import pytest
from fringeworks import streaming
from fringeworks.operators import bookkeeping, components, products, solvers, tiles, visibility, wavelets

UNIT = {"linear": {"I": [[1, 0], [0, 1]], "Q": [[1, 0], [0, -1]], "U": [[0, 1], [1, 0]], "V": [[0, 1j], [-1j, 0]]}, "circular": {"I": [[1, 0], [0, 1]], "Q": [[0, 1], [1, 0]], "U": [[0, 1j], [-1j, 0]], "V": [[1, 0], [0, -1]]}}
CELLS = [(0, 0), (0, 1), (1, 0), (1, 1)]


def tables(spark, feed, full, rng, truth):
    """Samples made of known Stokes parameters through random gains."""
    jones = rng.normal(size=(4, 2, 2)) * 0.2 + 1j * rng.normal(size=(4, 2, 2)) * 0.2 + np.eye(2)
    if not full:
        jones *= np.eye(2)
    gains = spark.createDataFrame(
        [(0, 1, a, *(float(f(jones[a][c])) for c in CELLS for f in (np.real, np.imag))) for a in range(3)],
        "time_id int, chan int, ant int, " + ", ".join(f"g{i}{j}_re double, g{i}{j}_im double" for i, j in CELLS),
    )
    sky = sum(truth[s] * np.array(m) for s, m in UNIT[feed].items())
    rows, weights = [], {}
    for p in range(4):
        for q in range(p + 1, 4):
            v, w = jones[p] @ sky @ jones[q].conj().T, rng.uniform(0.5, 2, (2, 2))
            rows.append((0, 1, p, q, (p, q) == (0, 2), *(float(x) for c in CELLS for x in (v[c].real, v[c].imag)), *(float(w[c]) for c in CELLS)))
            weights[p, q] = {s: sum(w[c] * abs((jones[p] @ np.array(m) @ jones[q].conj().T)[c]) ** 2 for c in CELLS) for s, m in UNIT[feed].items()}
    schema = "time_id int, chan int, ant1 int, ant2 int, flag boolean, " + ", ".join(f"c{i}{j}_re double, c{i}{j}_im double" for i, j in CELLS) + ", " + ", ".join(f"w{i}{j} double" for i, j in CELLS)
    return spark.createDataFrame(rows, schema), gains, weights


@pytest.mark.parametrize("feed", ["linear", "circular"])
@pytest.mark.parametrize("full", [False, True])
def test_products_give_back_the_sky(spark, feed, full):
    truth = {"I": 2.0, "Q": 0.3, "U": -0.4, "V": 0.1}
    vis, gains, weights = tables(spark, feed, full, np.random.default_rng(3), truth)
    got = products.stokes_products(vis, gains, "VIUQ", ["time_id", "chan"], feed, full=full).collect()
    assert len(got) == 6
    for r in got:
        lost = r.flag or r.ant2 == 3  # antenna 3 has no gains
        for s, v in truth.items():
            want = (0, 0, 0) if lost else (v, 0, weights[r.ant1, r.ant2][s])
            assert np.allclose((r[f"{s.lower()}_re"], r[f"{s.lower()}_im"], r[f"w_{s.lower()}"]), want)


def test_two_correlations_are_the_parallel_hands(spark):
    truth = {"I": 2.0, "Q": 0.3, "U": 0.0, "V": 0.0}
    vis, gains, _ = tables(spark, "linear", False, np.random.default_rng(4), truth)
    two = vis.drop(*(f"{c}{e}{p}" for e in ("01", "10") for c, p in (("c", "_re"), ("c", "_im"), ("w", ""))))
    got = products.stokes_products(two, gains, "IQ", ["time_id", "chan"], n_corr=2, mode="minvar").filter("NOT flag AND ant2 < 3").collect()
    assert len(got) == 2 and all(np.allclose((r.i_re, r.q_re), (2.0, 0.3)) and r.w_i > 0 for r in got)


@pytest.mark.parametrize(
    "args", [("IQ", "circular", 2, "l2", False), ("U", "linear", 2, "l2", False), ("V", "linear", 2, "l2", False), ("I", "linear", 4, "minvar", True), ("I", "linear", 2, "l2", True), ("IX", "linear", 4, "l2", False), ("I", "oval", 4, "l2", False), ("I", "linear", 1, "l2", False)]
)
def test_products_that_cannot_be_had(args):
    with pytest.raises(ValueError):
        products.wanted(*args)


def test_products_in_their_order():
    assert products.wanted("VI", "circular", 2, "l2", False) == ["I", "V"]


@pytest.mark.parametrize("name", ["db1", "db3", "db5"])
def test_wavelets_there_and_back(spark, name):
    """Odd sizes too; the coefficients are those of convolution and taking every second."""
    image = np.random.default_rng(5).normal(size=(12, 9))
    rows = [(x, y, float(image[x, y])) for x in range(12) for y in range(9)]
    table = wavelets.analysis(spark.createDataFrame(rows, "x int, y int, value double"), [], name, 2, 12, 9)
    got = {(r.level, r.kind, r.x, r.y): r.value for r in table.collect()}
    low, high = (np.array(f[::-1]) for f in wavelets.filters(name))
    rest = image
    for level in (1, 2):
        parts = {}
        for kind in ("LL", "LH", "HL", "HH"):
            f = [low if k == "L" else high for k in kind]
            half = np.apply_along_axis(lambda v: np.convolve(v, f[0])[1::2], 0, rest)
            parts[kind] = np.apply_along_axis(lambda v: np.convolve(v, f[1])[1::2], 1, half)
            if kind != "LL" or level == 2:
                assert all(abs(got.get((level, kind, i, j), 0.0) - v) < 1e-12 for (i, j), v in np.ndenumerate(parts[kind]))
        rest = parts["LL"]
    back = np.zeros((12, 9))
    for r in wavelets.synthesis(table, [], name, 2, 12, 9).collect():
        back[r.x, r.y] = r.value
    assert np.allclose(back, image)


def test_model_is_stored_and_read(spark, tmp_path):
    samples = [(t, f, 1.0) for t in (0.0, 1.0, 2.0) for f in (1.0, 1.5, 2.0)]
    truth = lambda t, f: 1 + t - 2 * f + 0.5 * t * f * f
    cube = spark.createDataFrame([(3, 4, i, truth(t, f)) for i, (t, f, _) in enumerate(samples)], "x int, y int, sample int, value double")
    model = components.fit_model(cube, samples, (2, 3))
    for form in ("parquet", "json"):
        path = str(tmp_path / form)
        components.write_model(model, path, form=form)
        with pytest.raises(Exception, match="(?i)exist"):
            components.write_model(model, path, form=form)
        (r,) = components.evaluate_model(components.read_model(spark, path, form), [(3.0, 0.5)]).collect()
        assert (r.x, r.y) == (3, 4) and abs(r.value - truth(3.0, 0.5)) < 1e-9
    (r,) = components.evaluate_model(components.union_of_models([model, model]), [(0.5, 1.2)]).collect()
    assert abs(r.value - 2 * truth(0.5, 1.2)) < 1e-9
    assert model.limit(0).count() == 0 and components.evaluate_model(model.filter("x < 0"), [(0.0, 1.0)]).count() == 0


def test_noise_is_normal_and_repeats(spark):
    vis = spark.range(20000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 4.0D WHEN id = 1 THEN 0.0D ELSE 1.0D END AS weight")
    a = bookkeeping.noise(vis, ["id"], 1).orderBy("id").toPandas()
    b = bookkeeping.noise(vis.repartition(7), ["id"], 1).orderBy("id").toPandas()
    assert a.equals(b) and a.n_re[1] == 0
    for part in (a.n_re, a.n_im):
        assert abs(part[a.weight == 4].var() * 4 - 1) < 0.05 and abs(part[a.weight == 1].var() - 1) < 0.05 and abs(part.mean()) < 0.03
    assert abs(np.corrcoef(a.n_re, a.n_im)[0, 1]) < 0.03


def test_planes(spark):
    rng = np.random.default_rng(6)
    xy = rng.normal(size=(200, 2)) * [3, 1]
    rows = [("flat", float(x), float(y), float(2 * x - y + 4)) for x, y in xy] + [("thick", *map(float, v)) for v in rng.normal(size=(200, 3))]
    table = spark.createDataFrame(rows, "kind string, u double, v double, w double")
    assert {r.kind: r.planar for r in bookkeeping.planar(table, ["kind"]).collect()} == {"flat": True, "thick": False}
    r = bookkeeping.hyperplane(table.filter("kind = 'flat'"), ["kind"], "u", "v", "w").first()
    assert np.allclose((r.t0, r.t1, r.t2), (2, -1, 4), atol=1e-5)


def test_times_across_days_and_null(spark):
    times = [0.0, 0.0, 5.0, 86400.0, 86401.0, 86401.0, 1e6, -3.0, None]
    vis = spark.createDataFrame([(t,) for t in times], "time double")
    assert [(r.time, r.n, r.start) for r in visibility.time_bins(vis).orderBy("time").collect()] == [(-3.0, 1, 0), (0.0, 2, 1), (5.0, 1, 3), (86400.0, 1, 4), (86401.0, 2, 5), (1e6, 1, 7)]
    assert [r.block for r in visibility.time_blocks(vis, 4).orderBy("time").collect()] == [0, 0, 0, 0, 1, 1]


def test_running_mean_of_a_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "state")
    for part in ([(0, 1.0, 1.0), (1, None, 1.0)], [(0, 4.0, 2.0), (1, 5.0, 0.0)]):
        spark.createDataFrame(part, "x int, value double, weight double").coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema("x int, value double, weight double").option("maxFilesPerTrigger", 1).parquet(source)
    run = streaming.running_mean(rows, ["x"]).writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", sink).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.x, r.value, r.weight) for r in spark.table("means").collect()} == {(0, 3.0, 3.0), (1, None, 0.0)}


def test_solvers_solve(spark):
    """Conjugate gradients leave no residual, the norm bounds the operator, and a Gaussian's own beam is found."""
    psf, rng = solvers.gaussian_kernel(16, 1.5, 1.2, 0.4), np.random.default_rng(7)
    image = rng.normal(size=(8, 8))
    rows = spark.createDataFrame([(0, x, y, float(image[x, y])) for x in range(8) for y in range(8)], "band int, x int, y int, value double")
    h, got = solvers.hessian(psf, 0.1), np.zeros((8, 8))
    kernel = spark.createDataFrame([(0, i - 8, j - 8, float(psf[i, j])) for i in range(16) for j in range(16)], "band int, dx int, dy int, value double")
    a = tiles.Hessian(tiles.Kernel.of(kernel, rows, 8), 0.1)
    for r in tiles.solve(rows, a).collect():
        got[r.x, r.y] = r.value
    assert np.linalg.norm(h(got) - image) < 1e-3 * np.linalg.norm(image)
    norm = tiles.spectral_norms(rows, a)[0][0]
    dense = np.array([h(e.reshape(8, 8)).ravel() for e in np.eye(64)])
    assert abs(norm / np.linalg.eigvalsh((dense + dense.T) / 2)[-1] - 1) < 1e-3
    beam = solvers.gaussian_kernel(32, 5.0, 3.0, 0.6)
    table = spark.createDataFrame([(0, x, y, float(beam[x, y])) for x in range(32) for y in range(32)], "band int, x int, y int, value double")
    r = solvers.fit_beams(table, 32, 32).first()
    assert np.allclose((r.bmaj, r.bmin, r.bpa), (5.0, 3.0, 0.6), atol=1e-3)
