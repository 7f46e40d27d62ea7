"""Images as functions of white parameters, correlated over frequency.

A pixel's bands are x = L s, or exp(L s), where L L' is a squared-exponential
covariance of the bands.  The factor is as large as there are bands, so it is a
part of the plan; each pixel's bands meet in an array by partial sums, in one
shuffle, and products and eliminations are expressions on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _product(matrix: np.ndarray, vector: Column) -> Column:
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in matrix))
    return F.transform(rows, lambda row: _dot(row, vector))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)


def _eliminated(lower: np.ndarray, vector: Column) -> Column:
    """The solution of lower s = vector, one band after the other."""
    rows, diagonal = (F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in lower)), F.array(*(F.lit(float(v)) for v in np.diag(lower))))
    none = F.array().cast("array<double>")
    add = lambda s, k: F.concat(s, F.array((F.get(vector, k) - _dot(F.slice(F.get(rows, k), 1, k), s)) / F.get(diagonal, k)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(lower) - 1)), none, add)


@dataclass
class FrequencyPrior:
    """A parametrisation of cubes with rows (keys, band, value); bands are counted from 0 in the order of ``freqs``.

    sigma: standard deviation of a band; scale: correlation length, as a share of
    the mean frequency.  exponential: whether images are exp(L s), and positive.
    Bands that a pixel lacks, and null values, count as 0; rows of one pixel and
    band are added up.
    """

    freqs: list[float]
    sigma: float = 1.0
    scale: float = 1.0
    exponential: bool = False
    floor: float = 1e-5
    jitter: float = 1e-10
    factor: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if not self.freqs or self.sigma <= 0 or self.scale <= 0:
            raise ValueError("a prior needs frequencies, and a positive deviation and length")
        nu = np.asarray(self.freqs, float) / np.mean(self.freqs)
        covariance = self.sigma**2 * np.exp(-0.5 * ((nu[:, None] - nu) / self.scale) ** 2)
        self.factor = np.linalg.cholesky(covariance + self.jitter * np.eye(len(nu)))

    def _mapped(self, cube: DataFrame, keys: list[str], columns: list[str], work: Callable[..., Column]) -> DataFrame:
        """work on the arrays of each pixel's bands."""
        bands = range(len(self.freqs))
        arrays = (F.array(*(F.coalesce(F.sum(F.when(F.col("band") == k, F.col(c).cast("double"))), F.lit(0.0)) for k in bands)).alias(f"_{i}") for i, c in enumerate(columns))
        pixels = cube.groupBy(*keys).agg(*arrays)
        return pixels.select(*keys, F.posexplode(work(*(F.col(f"_{i}") for i in range(len(columns))))).alias("band", "value"))

    def image(self, parameters: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, band, value): the images of parameters."""
        made = self._mapped(parameters, keys, ["value"], lambda s: _product(self.factor, s))
        return made.withColumn("value", F.exp("value")) if self.exponential else made

    def parameters(self, images: DataFrame, keys: list[str]) -> DataFrame:
        """The parameters of images; of an exponential prior, those of values no less than ``floor``."""
        held = lambda x: F.transform(x, lambda v: F.log(F.greatest(v, F.lit(self.floor)))) if self.exponential else x
        return self._mapped(images, keys, ["value"], lambda x: _eliminated(self.factor, held(x)))

    def moved(self, parameters: DataFrame, keys: list[str]) -> DataFrame:
        """The Jacobian at ``value`` times ``direction``, two columns of parameters."""

        def work(s: Column, d: Column) -> Column:
            along = _product(self.factor, d)
            return F.zip_with(_product(self.factor, s), along, lambda x, v: F.exp(x) * v) if self.exponential else along

        return self._mapped(parameters, keys, ["value", "direction"], work)

    def gradient(self, parameters: DataFrame, keys: list[str]) -> DataFrame:
        """The adjoint Jacobian at ``value`` times ``direction``, a column of images: a gradient by the parameters."""

        def work(s: Column, d: Column) -> Column:
            seen = F.zip_with(_product(self.factor, s), d, lambda x, v: F.exp(x) * v) if self.exponential else d
            return _product(self.factor.T, seen)

        return self._mapped(parameters, keys, ["value", "direction"], work)
