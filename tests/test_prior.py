"""Priors over frequency against dense matrices, finite differences and the adjoint's definition."""

import numpy as np
import pytest
from fringeworks.operators.prior import FrequencyPrior

FREQS = [1.0e9, 1.1e9, 1.25e9, 1.3e9, 1.6e9]
KEYS = ["x", "y"]


def frame(spark, value, direction=None):
    rows = [(x, y, b, float(value[b, x, y]), float((value if direction is None else direction)[b, x, y])) for b in range(len(FREQS)) for x in range(3) for y in range(2)]
    return spark.createDataFrame(rows, "x int, y int, band int, value double, direction double")


def dense(df):
    out = np.full((len(FREQS), 3, 2), np.nan)
    for r in df.collect():
        out[r.band, r.x, r.y] = r.value
    return out


@pytest.mark.parametrize("exponential", [False, True])
def test_like_dense_matrices(spark, exponential):
    prior = FrequencyPrior(FREQS, 0.7, 0.1, exponential)
    rng = np.random.default_rng(0)
    s, d = rng.normal(size=(2, len(FREQS), 3, 2))
    nu = np.array(FREQS) / np.mean(FREQS)
    k = 0.49 * np.exp(-((nu[:, None] - nu) ** 2) / 0.02) + 1e-10 * np.eye(len(nu))
    assert np.allclose(prior.factor @ prior.factor.T, k, atol=1e-14) and not np.triu(prior.factor, 1).any()
    of = lambda s: (np.exp if exponential else np.asarray)(np.einsum("bc,cxy->bxy", prior.factor, s))
    x = dense(prior.image(frame(spark, s), KEYS))
    assert np.allclose(x, of(s), rtol=1e-12)
    assert np.allclose(dense(prior.parameters(frame(spark, x), KEYS)), s, rtol=1e-8)
    moved = dense(prior.moved(frame(spark, s, d), KEYS))
    assert np.allclose(moved, (of(s + 1e-6 * d) - of(s - 1e-6 * d)) / 2e-6, rtol=1e-6, atol=1e-8)
    v = rng.normal(size=s.shape)
    assert np.isclose((dense(prior.gradient(frame(spark, s, v), KEYS)) * d).sum(), (moved * v).sum(), rtol=1e-10)


def test_what_pixels_lack(spark):
    """Missing bands and nulls count as 0, rows of one band are added up, and the floor bounds what has no logarithm."""
    rows = [(0, 0, 0, 1.0), (0, 0, 0, 1.0), (0, 0, 2, None), (1, 0, 4, 3.0)]
    cube = spark.createDataFrame(rows, "x int, y int, band int, value double")
    prior = FrequencyPrior(FREQS, 1.0, 0.1)
    got = {(r.x, r.band): r.value for r in prior.image(cube, KEYS).collect()}
    assert len(got) == 10 and all(np.isclose(got[0, b], 2 * prior.factor[b, 0]) and np.isclose(got[1, b], 3 * prior.factor[b, 4]) for b in range(5))
    log = FrequencyPrior(FREQS, 1.0, 0.1, exponential=True, floor=0.5)
    back = log.image(log.parameters(cube, KEYS), KEYS).collect()
    assert np.allclose(sorted(r.value for r in back), sorted([2, *[0.5] * 4, 3, *[0.5] * 4]))
    assert prior.image(cube.limit(0), KEYS).count() == 0
    with pytest.raises(ValueError, match="positive"):
        FrequencyPrior(FREQS, scale=0.0)


def test_one_shuffle_without_python(spark):
    plan = FrequencyPrior(FREQS).moved(frame(spark, np.ones((5, 3, 2))), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
