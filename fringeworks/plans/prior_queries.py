"""Queries on priors over frequency; SQL states their covariance, so no factor of it is handed to both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.prior import FrequencyPrior
from .image_queries import BANDS, BXY, FREQS, PIX, bands_of
from .registry import query, rounded

SIGMA, SCALE = 0.8, 0.012
_NU = "(1e9 + 1e7 * {}) / 1.045e9"
_K = f"({SIGMA * SIGMA!r}e0 * exp(-0.5e0 * power(({_NU.format('o')} - {_NU.format('band')}) / {SCALE!r}e0, 2)) + CASE WHEN o = band THEN 1e-10 ELSE 0e0 END)"
#: k: the covariance times the images, w: times the images weighted by their bands.
_SUMS = f"{BANDS}, sums AS (SELECT o, x, y, sum({_K} * value) AS k, sum({_K} * value * (1 + band)) AS w FROM bands, range(10) r(o) GROUP BY ALL)"


def _white(spark, sf_dir):
    """Images, parameters whose image is the covariance times them, and the same of weighted images."""
    line = FrequencyPrior(FREQS, SIGMA, SCALE)
    bands = bands_of(spark, sf_dir)
    none = bands.withColumn("direction", F.col("value"))
    weighted = bands.withColumn("direction", F.col("value") * (1 + F.col("band")))
    return bands, line.gradient(none, PIX), line.gradient(weighted, PIX).withColumnRenamed("value", "direction")


@query(f"{_SUMS} SELECT CAST(o AS INT) AS band, x, y, round(k, 6) + 0 AS value FROM sums")
def frequency_prior_covariance(spark, sf_dir):
    """The covariance of a prior times every pixel's bands, as its factor times the factor's adjoint."""
    _, white, _ = _white(spark, sf_dir)
    return rounded(FrequencyPrior(FREQS, SIGMA, SCALE).image(white, PIX).select(*BXY, "value"), *BXY)


@query(f"{_SUMS} SELECT s.x, s.y, round(sum(k * value), 5) + 0 AS chi2 FROM sums s JOIN bands b ON s.o = b.band AND s.x = b.x AND s.y = b.y GROUP BY s.x, s.y")
def frequency_prior_chi2(spark, sf_dir):
    """Squares of the parameters of images, by elimination: the images' chi-squared under the prior."""
    _, white, _ = _white(spark, sf_dir)
    prior = FrequencyPrior(FREQS, SIGMA, SCALE)
    again = prior.parameters(prior.image(white, PIX), PIX)
    return rounded(again.groupBy(*PIX).agg(F.sum(F.col("value") * F.col("value")).alias("chi2")), *PIX, digits=5)


@query(f"{_SUMS} SELECT CAST(o AS INT) AS band, x, y, round(exp(k), 6) + 0 AS value, round(exp(k) * w, 6) + 0 AS moved FROM sums")
def frequency_prior_exponential(spark, sf_dir):
    """Positive images of parameters, and how they move along a direction."""
    _, white, direction = _white(spark, sf_dir)
    prior = FrequencyPrior(FREQS, SIGMA, SCALE, exponential=True)
    moved = prior.moved(white.join(direction, BXY), PIX).withColumnRenamed("value", "moved")
    return rounded(prior.image(white, PIX).join(moved, BXY).select(*BXY, "value", "moved"), *BXY)
