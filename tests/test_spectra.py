"""Power laws against a plain loop, and at their edges."""

import numpy as np
from fringeworks.operators import spectra

FREQS = np.array([0.9e9, 1.0e9, 1.2e9, 1.5e9, 1.7e9])


def loop(v, w, a=1.0, s=-0.7, rounds=200):
    """Undamped steps from the truth's neighbourhood."""
    t = FREQS / 1e9
    for _ in range(rounds):
        shape = t**s
        j = np.stack([shape, a * shape * np.log(t)], 1)
        d = np.linalg.solve((j.T * w) @ j, (j.T * w) @ (v - a * shape))
        a, s = a + d[0], s + d[1]
    return a, s, np.linalg.inv((j.T * w) @ j)


def test_like_a_plain_loop(spark):
    """Slopes far from the start, negative amplitudes, and noise that makes some values negative."""
    rng = np.random.default_rng(0)
    truth = [(2.0, -0.7), (0.5, 2.5), (-1.0, -3.0), (5.0, 0.0), (0.3, -1.5)]
    rows, want = [], []
    for k, (a, s) in enumerate(truth):
        v, w = a * (FREQS / 1e9) ** s + 0.02 * rng.normal(size=5), rng.uniform(0.5, 2, 5)
        rows += [(k, float(f), float(x), float(y)) for f, x, y in zip(FREQS, v, w)]
        want.append(loop(v, w, a, s))
    rows += [(0, 1.1e9, None, 1.0), (0, 1.1e9, float("nan"), 1.0), (0, 1.1e9, 9.0, 0.0), (0, 0.0, 9.0, 1.0), (0, None, 9.0, 1.0), (0, 1.1e9, 9.0, None)]
    got = {r.id: r for r in spectra.power_laws(spark.createDataFrame(rows, "id int, freq double, value double, weight double"), ["id"], 1e9).collect()}
    for k, (a, s, cov) in enumerate(want):
        r = got[k]
        assert r.converged and r.n == 5
        assert np.allclose([r.amplitude, r.slope], [a, s], rtol=1e-6, atol=1e-6) and np.allclose([r.amplitude_var, r.slope_var], np.diag(cov), rtol=1e-5)


def test_too_few_frequencies_and_nothing(spark):
    """One frequency twice, no sample that counts, values of zero, and an empty table."""
    rows = [(0, 1e9, 1.0, 1.0), (0, 1e9, 2.0, 1.0), (1, 1e9, None, 1.0), (2, 1e9, 0.0, 1.0), (2, 2e9, 0.0, 1.0)]
    table = spark.createDataFrame(rows, "id int, freq double, value double, weight double")
    got = {r.id: r for r in spectra.power_laws(table, ["id"], 1e9).collect()}
    assert got[0].amplitude is None and got[0].n == 2 and not got[0].converged
    assert got[1].amplitude is None and got[1].n == 0 and got[2].amplitude == 0.0 and got[2].n == 2
    assert spectra.power_laws(table.limit(0), ["id"], 1e9).count() == 0
