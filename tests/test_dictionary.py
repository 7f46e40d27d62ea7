"""Several bases at once: coefficients, and the primal-dual solver against a plain solver of another kind."""

import warnings

import numpy as np
import pytest
from fringeworks.operators import dictionary, solvers, tiles
from test_whole_jobs import PSFS, N, cube, dense, kernels, seen

BASES = (0, 2)


def test_haar_is_orthonormal():
    matrix = np.stack([dictionary.haar(e.reshape(8, 8), 3).ravel() for e in np.eye(64)])
    assert np.allclose(matrix @ matrix.T, np.eye(64)) and not np.allclose(matrix, np.eye(64))
    v = np.random.default_rng(0).normal(size=(8, 8))
    assert np.allclose(dictionary.haar_back(dictionary.haar(v, 3), 3), v) and np.isclose(dictionary.haar(v, 3)[0, 0], v.sum() / 8)


def test_analysis_of_tiles_is_that_of_the_image(spark):
    """Tiles of four pixels hold the coefficients of two levels that the whole image has."""
    v = np.random.default_rng(1).normal(size=(2, N, N))
    got = np.zeros((2, 2, N, N))
    for r in dictionary.analysis(cube(spark, v), BASES, 4).collect():
        if r.basis == 0:
            at = (r.tx * 4 + r.i, r.ty * 4 + r.j)
        elif r.i < 2 and r.j < 2:  # averages and last details are one each a tile
            at = (r.i * 2 + r.tx, r.j * 2 + r.ty)
        else:  # first details are two along an axis
            at = tuple((4 if i >= 2 else 0) + t * 2 + i % 2 for i, t in ((r.i, r.tx), (r.j, r.ty)))
        got[r.band, BASES.index(r.basis)][at] = r.value
    for b in range(2):
        assert np.allclose(got[b, 0], v[b]) and np.allclose(got[b, 1], dictionary.haar(v[b], 2))
    with pytest.raises(ValueError, match="bases"):
        dictionary.analysis(cube(spark, v), (0, 3), 4)


def plain(b, weight, ws, eta=0.2, rounds=4000, rho=1.0):
    """Alternating directions with dense matrices: x = z in each basis, and x = y >= 0."""
    psi = [np.stack([dictionary.haar(e.reshape(N, N), k).ravel() for e in np.eye(N * N)]).T for k in BASES]
    h = [np.stack([(solvers.convolve(e.reshape(N, N), solvers.kernel_transform(p), p.shape) + eta * e.reshape(N, N)).ravel() for e in np.eye(N * N)]).T for p in PSFS]
    inverse = [np.linalg.inv(a + rho * (len(psi) + 1) * np.eye(N * N)) for a in h]
    b = b.reshape(2, -1)
    z, u = [np.zeros((2, N * N)) for _ in range(3)], [np.zeros((2, N * N)) for _ in range(3)]
    for _ in range(rounds):
        x = np.stack([inverse[k] @ (b[k] + rho * (sum(p.T @ (z[i][k] - u[i][k]) for i, p in enumerate(psi)) + z[2][k] - u[2][k])) for k in range(2)])
        for i, p in enumerate(psi):
            c = x @ p.T + u[i]
            z[i] = c * np.maximum(1 - weight * ws[i] / rho / np.maximum(np.sqrt((c**2).sum(0)), 1e-300), 0)
            u[i] = c - z[i]
        c = x + u[2]
        z[2] = np.maximum(c, 0)
        u[2] = c - z[2]
    return z[2].reshape(2, N, N)


@pytest.mark.parametrize("reweights", [0, 1])
def test_primal_dual_on_two_bases_and_two_bands(spark, reweights):
    b = seen(np.maximum(np.random.default_rng(5).normal(size=(2, N, N)), 0)) + 0.3 * np.random.default_rng(6).normal(size=(2, N, N))
    rows = cube(spark, b)
    a = tiles.Hessian(tiles.Kernel.of(kernels(spark, PSFS), rows, N), 0.2)
    x = dense(dictionary.primal_dual(rows, a, 0.3, BASES, reweights, tol=1e-5))
    want = plain(b, 0.3, [1.0, 1.0])
    for _ in range(reweights):
        sizes = [np.sqrt(sum(dictionary.haar(v, k) ** 2 for v in want)).ravel() for k in BASES]
        want = plain(b, 0.3, [2 / (1 + s / np.sqrt((s**2).mean())) for s in sizes])
    assert want.any() and (want == 0).any() and np.abs(x - want).max() < 1e-3 * np.abs(want).max()


def test_ends_and_warns(spark):
    """No images, images of nothing, and too few rounds."""
    rows = cube(spark, np.zeros((2, N, N)))
    a = tiles.Hessian(tiles.Kernel.of(kernels(spark, PSFS), rows, N), 0.2)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        assert not dense(dictionary.primal_dual(rows, a, 0.3, BASES)).any()
        assert dictionary.primal_dual(rows.limit(0), a, 0.3, BASES).count() == 0
    some = cube(spark, np.ones((2, N, N)))
    with pytest.warns(RuntimeWarning, match="primal_dual"):
        dictionary.primal_dual(some, a, 0.3, BASES, most=2)
