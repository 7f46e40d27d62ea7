"""Queries that convolve, solve and clean; invariants are held by the tests where SQL has no say."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import images, solvers, tiles
from .image_queries import BANDS, BXY, bands_of
from .registry import query, rounded

N = 8
#: Where CLEAN ends: a share of the first peak, and a limit of steps that it does not reach.
HOGBOM_SHARE, HOGBOM_STEPS = 0.2, 2000
#: Where clark ends, as a share of the first peak.
CLARK_SHARE = 0.3
PSF = solvers.gaussian_kernel(16, 3.0, 2.0, 0.4)


def _offsets(kernel: np.ndarray) -> str:
    return "psf(dx, dy, k) AS (VALUES " + ", ".join(f"({i - 8}, {j - 8}, CAST({float(kernel[i, j])!r} AS DOUBLE))" for i in range(16) for j in range(16)) + ")"


_OFFSETS = _offsets(PSF)
#: A Gaussian kernel for each band, by the displacement from its centre.
_KERNEL = "exp(-(0.3e0 + 0.02e0 * (band % 3)) * dx * dx - 0.5e0 * dy * dy)"
_KERNELS = f"psfs AS (SELECT band, dx, dy, {_KERNEL} AS k FROM (SELECT DISTINCT band FROM bands), range(-8, 8) i(dx), range(-8, 8) j(dy))"


def psfs_of(bands: DataFrame) -> DataFrame:
    """(band, dx, dy, value): the kernels of the queries."""
    side = F.explode(F.sequence(F.lit(-8), F.lit(7)))
    grid = bands.select("band").distinct().select("band", side.alias("dx")).select("band", "dx", side.alias("dy"))
    return grid.withColumn("value", F.expr(_KERNEL.replace("e0", "D").replace("0.02D * (band % 3)", "0.02D * pmod(band, 3)")))


def _convolved(source: str, kernels: str = "psf", on: str = "TRUE") -> str:
    """SQL of a table's images less what leaves their frame."""
    return f"""(SELECT b.band, CAST(b.x + dx AS INT) AS x, CAST(b.y + dy AS INT) AS y, sum(b.value * k) AS value
        FROM {source} b JOIN {kernels} ON {on} WHERE b.x + dx BETWEEN 0 AND 7 AND b.y + dy BETWEEN 0 AND 7 GROUP BY ALL)"""


_BY_BAND = _convolved("bands", "psfs p", "p.band = b.band")


def _problem(spark, sf_dir, tile=N, eta=0.1):
    """The images of all bands, and the Hessian of their kernels."""
    bands = bands_of(spark, sf_dir)
    return bands, tiles.Hessian(tiles.Kernel.of(psfs_of(bands), bands, tile), eta)


@query(f"{BANDS}, {_KERNELS} SELECT band, x, y, round(value, 6) + 0 AS value FROM {_BY_BAND}")
def psf_convolve(spark, sf_dir):
    """In tiles of 4 x 4 pixels, each with a halo as wide as the image."""
    bands, h = _problem(spark, sf_dir, 4)
    return rounded(tiles.convolve(bands, h.kernel), *BXY)


@query(f"{BANDS}, {_KERNELS} SELECT band, x, y, round(c.value + 0.1e0 * b.value, 6) + 0 AS value FROM {_BY_BAND} c JOIN bands b USING (band, x, y)")
def hessian_apply(spark, sf_dir):
    bands, h = _problem(spark, sf_dir)
    return rounded(tiles.convolve(bands, h.kernel, eta=h.eta), *BXY)


@query()
def cg_solve(spark, sf_dir):
    return rounded(tiles.solve(*_problem(spark, sf_dir)), *BXY)


@query(f"{BANDS}, {_KERNELS} SELECT band, x, y, round(value, 4) + 0 AS value FROM bands")
def cg_round_trip(spark, sf_dir):
    """The Hessian applied to the solution gives the right side back."""
    bands, h = _problem(spark, sf_dir)
    return rounded(tiles.convolve(tiles.solve(bands, h), h.kernel, eta=h.eta), *BXY, digits=4)


@query()
def power_norm(spark, sf_dir):
    """The largest eigenvalue of each band's Hessian."""
    norms = tiles.spectral_norms(*_problem(spark, sf_dir))
    return rounded(spark.createDataFrame([(b, v) for b, (v, _) in norms.items()], "band int, norm double"), "band")


@query(f"""WITH RECURSIVE {BANDS[5:]}, start AS (SELECT list(value ORDER BY band, x, y) AS r, list(DISTINCT band ORDER BY band) AS ids FROM bands),
    steps(k, r, m, ids, goal) AS (SELECT 0, r, list_transform(r, lambda v: 0e0), ids, {HOGBOM_SHARE}e0 * (SELECT max(abs(s)) FROM (SELECT sum(value) AS s FROM bands GROUP BY x, y)) FROM start
    UNION ALL SELECT k + 1, list_transform(r, lambda v, j: v - 0.1e0 * r[(j - 1) // 64 * 64 + p] * exp(-abs((j - 1) % 64 // 8 - (p - 1) // 8) - abs((j - 1) % 8 - (p - 1) % 8)))
        , list_transform(m, lambda v, j: v + CASE WHEN (j - 1) % 64 + 1 = p THEN 0.1e0 * r[j] ELSE 0 END), ids, goal
        FROM (SELECT *, list_position(powers, list_max(powers)) AS p FROM (SELECT *, list_transform(sums, lambda v: round(v * v, 12)) AS powers
            FROM (SELECT *, list_transform(range(1, 65), lambda q: list_sum(list_transform(range(len(ids)), lambda b: r[b * 64 + q]))) AS sums FROM steps)))
        WHERE abs(sums[p]) > goal AND k < {HOGBOM_STEPS})
    SELECT ids[(i - 1) // 64 + 1] AS band, CAST((i - 1) % 64 // 8 AS INT) AS x, CAST((i - 1) % 8 AS INT) AS y, round(m[i], 6) + 0 AS model, round(r[i], 6) + 0 AS residual
    FROM steps, range(1, 64 * len(ids) + 1) t(i) WHERE k = (SELECT max(k) FROM steps)""")
def hogbom_small(spark, sf_dir):
    """All bands, to a share of the first peak of their sum, with an exponential kernel."""
    d = np.abs(np.arange(17) - 8)
    kernel = np.exp(-d[:, None] - d[None, :])
    model, residual = solvers.hogbom(bands_of(spark, sf_dir), kernel, 0.1, 0.0, HOGBOM_STEPS, HOGBOM_SHARE)
    out = residual.join(model.withColumnRenamed("value", "model"), BXY, "left")
    return rounded(out.select(*BXY, F.coalesce("model", F.lit(0.0)).alias("model"), F.col("value").alias("residual")), *BXY)


@query()
def clark(spark, sf_dir):
    return rounded(solvers.clark(bands_of(spark, sf_dir), PSF, share=CLARK_SHARE, tile=N), *BXY)


@query()
def nnls(spark, sf_dir):
    return rounded(tiles.nnls(*_problem(spark, sf_dir)), *BXY, digits=4)


@query()
def fista(spark, sf_dir):
    return rounded(tiles.fista(*_problem(spark, sf_dir), 0.01), *BXY, digits=4)


@query()
def primal_dual(spark, sf_dir):
    return rounded(solvers.primal_dual(bands_of(spark, sf_dir), PSF, N, N, 0.01), *BXY)


@query()
def forward_backward(spark, sf_dir):
    return rounded(tiles.forward_backward(*_problem(spark, sf_dir), 0.01), *BXY, digits=4)


@query()
def fit_beam(spark, sf_dir):
    """Beams fitted to the PSFs that the visibilities give, in pixels, for each band."""
    from ..operators import imaging
    from ..sources import vis_of
    from .vis_queries import CELL, band_time

    vis = band_time(vis_of(spark, sf_dir))
    psfs = imaging.normalised(imaging.direct_image(vis, 16, 16, CELL, ["band_id"], value="psf"), imaging.weight_sums(vis, ["band_id"]), ["band_id"])
    return rounded(solvers.fit_beams(psfs.withColumnRenamed("band_id", "band"), 16, 16), "band", digits=4)


@query(f"{BANDS}, {_OFFSETS}, positive AS (SELECT band, x, y, greatest(value, 0) AS value FROM bands) SELECT band, x, y, round(c.value + b.value, 6) + 0 AS value FROM {_convolved('positive')} c JOIN bands b USING (band, x, y)")
def restore(spark, sf_dir):
    b = bands_of(spark, sf_dir)
    beam = spark.createDataFrame([(i - 8, j - 8, float(PSF[i, j])) for i in range(16) for j in range(16)], "dx int, dy int, value double")
    beams = tiles.Kernel.of(b.select("band").distinct().join(F.broadcast(beam)), b, N)  # one beam of 256 pixels for all bands
    return rounded(solvers.restore(images.positive(b, ["x", "y"], 1), b, beams), *BXY)


@query(f"{BANDS} SELECT band, x, y, round(value * 6, 6) + 0 AS value FROM bands")
def psi_roundtrip(spark, sf_dir):
    """Six bases: synthesis of the analysis is six times the image."""
    return rounded(solvers.wavelet_round_trip(bands_of(spark, sf_dir), N, N, ["self", "db1", "db2", "db3", "db4", "db5"]), *BXY)


@query(f"{BANDS} SELECT count(DISTINCT x * 8 + y) AS components, count(DISTINCT band) AS n_bands, count(*) AS n_values FROM bands")
def cube_extent(spark, sf_dir) -> DataFrame:
    return bands_of(spark, sf_dir).agg(F.countDistinct(F.col("x") * 8 + F.col("y")).alias("components"), F.countDistinct("band").alias("n_bands"), F.count("*").alias("n_values"))


@query(f"{BANDS}, r AS (SELECT band, stddev_pop(value) AS rms, 1e0 + band AS bmaj, 1e0 + 0.5e0 * band AS bmin, 0.1e0 * band AS bpa FROM bands GROUP BY band) SELECT max(bmaj) AS bmaj, max(bmin) AS bmin, round(avg(bpa), 6) AS bpa FROM r")
def lowest_resolution(spark, sf_dir):
    """Largest axes and mean angle of the bands' beams."""
    b = bands_of(spark, sf_dir).select("band").distinct()
    return b.agg(F.max(1.0 + F.col("band")).alias("bmaj"), F.max(1.0 + 0.5 * F.col("band")).alias("bmin"), F.round(F.avg(0.1 * F.col("band")), 6).alias("bpa"))


@query(f"{BANDS} SELECT band, x, y, round(value, 6) + 0 AS value, CAST(row_number() OVER (PARTITION BY x, y ORDER BY band) AS INT) AS place FROM bands")
def band_order(spark, sf_dir):
    """Bands in order, for sinks that stack them."""
    return rounded(bands_of(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("x", "y").orderBy("band"))), *BXY, "place")
