"""Queries on Hessians summed over partitions (the fields of each band, their PSFs and dirty images from one scan), on several bases and on spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, imaging, partitions, spectra, tiles
from ..sources import vis_of
from .image_queries import BANDS, BXY, bands_of
from .registry import query, rounded
from .tables import stored
from .vis_queries import BT, CELL, DIRTY, PHASE, PIXELS, band_time

N, ETA = 8, 0.1
#: A field's beam, off centre by the field.
_BEAM = "exp(-0.02e0 * ((x - 3 - part % 3) * (x - 3 - part % 3) + (y - 4) * (y - 4)))"
_IMAGES = f"""{BT}, {PIXELS}, sums AS (SELECT band_id AS band, field_id AS part, x - 8 AS dx, y - 8 AS dy, sum(weight * cos{PHASE}) AS k, {DIRTY} AS d FROM bt, pixels WHERE NOT flag GROUP BY ALL),
    totals AS (SELECT band, sum(k) AS total FROM sums WHERE dx = 0 AND dy = 0 GROUP BY band),
    images AS (SELECT band, dx + 4 AS x, dy + 4 AS y, sum(d) / any_value(total) AS value FROM sums JOIN totals USING (band) WHERE dx BETWEEN -4 AND 3 AND dy BETWEEN -4 AND 3 GROUP BY ALL)"""


def _problem(spark, sf_dir, tile=N):
    """Dirty images of the bands, and the Hessian over their fields."""
    vis = band_time(vis_of(spark, sf_dir)).withColumn("part", F.col("field_id"))
    sums = stored(imaging.product_sums(vis, N, N, CELL, ["band_id", "part"]).withColumnRenamed("band_id", "band"), "products")
    psfs = sums.filter("product = 'psf'").select("band", "part", (F.col("x") - N).alias("dx"), (F.col("y") - N).alias("dy"), "value")
    totals = psfs.filter("dx = 0 AND dy = 0").groupBy("band").agg(F.sum("value").alias("total"))
    dirty = sums.filter("product = 'dirty'").groupBy(*BXY).agg(F.sum("value").alias("value")).join(totals, "band")
    images = stored(dirty.select(*BXY, (F.col("value") / F.col("total")).alias("value")), "dirty")
    beams = sums.filter("product = 'dirty'").select("band", "part", "x", "y", F.expr(_BEAM.replace("e0", "D")).alias("beam"))
    return images, tiles.Hessian(partitions.PartKernel.of(psfs, beams, images, tile), ETA)


@query(f"""{_IMAGES}, beams AS (SELECT DISTINCT i.band, part, x, y, {_BEAM} AS beam FROM images i JOIN sums USING (band)),
    seen AS (SELECT i.band, CAST(i.x + dx AS INT) AS x, CAST(i.y + dy AS INT) AS y, s.part, sum(i.value * b.beam * k) AS seen
        FROM images i JOIN beams b USING (band, x, y) JOIN sums s ON s.band = b.band AND s.part = b.part WHERE i.x + dx BETWEEN 0 AND 7 AND i.y + dy BETWEEN 0 AND 7 GROUP BY ALL),
    parts AS (SELECT band, x, y, sum(seen * beam) AS value FROM seen JOIN beams USING (band, part, x, y) GROUP BY ALL)
    SELECT band, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(p.value / total + {ETA!r}e0 * i.value, 6) + 0 AS value FROM parts p JOIN images i USING (band, x, y) JOIN totals USING (band)""")
def hessian_partitions(spark, sf_dir):
    """The bands' dirty images through the sum of their fields' kernels, each under its beam; in tiles of 4 x 4 pixels."""
    images, h = _problem(spark, sf_dir, 4)
    return rounded(tiles.convolve(images, h.kernel, eta=h.eta), *BXY)


@query(f"{_IMAGES} SELECT band, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(value, 4) + 0 AS value FROM images")
def hessian_partitions_solved(spark, sf_dir):
    """Conjugate gradients over all fields of a band: the Hessian applied to the solution gives the dirty image back."""
    images, h = _problem(spark, sf_dir)
    return rounded(tiles.convolve(tiles.solve(images, h, tol=1e-6), h.kernel, eta=h.eta), *BXY, digits=4)


@query(f"""{BANDS}, levels AS (SELECT *, CAST(pow(2, k) AS INT) AS size FROM range(1, 4) a(k), range(2) b(sx), range(2) c(sy) WHERE sx + sy > 0 OR k = 3)
    SELECT band, 3 AS basis, CAST(x // size + sx * (8 // size) AS INT) AS i, CAST(y // size + sy * (8 // size) AS INT) AS j,
        round(sum(value * CASE WHEN sx * (x % size // (size // 2)) = 1 THEN -1 ELSE 1 END * CASE WHEN sy * (y % size // (size // 2)) = 1 THEN -1 ELSE 1 END) / any_value(size), 6) + 0 AS value
    FROM bands, levels GROUP BY band, x // size, y // size, size, sx, sy
    UNION ALL SELECT band, 0, x, y, round(value, 6) + 0 FROM bands""")
def dictionary_coefficients(spark, sf_dir):
    """The bands' images in two bases: pixels, and three Haar levels."""
    return rounded(dictionary.analysis(bands_of(spark, sf_dir), (0, 3), N).drop("tx", "ty"), "band", "basis", "i", "j")


@query()
def dictionary_fit(spark, sf_dir):
    """Images sparse in pixels and in two Haar levels, with the kernels and beams of all fields."""
    images, h = _problem(spark, sf_dir)
    return rounded(dictionary.primal_dual(images, tiles.Hessian(h.kernel, 0.5), 0.002, (0, 2), tol=1e-3), *BXY, digits=4)


_STEP = "list_sum(list_transform(range(1, len(t) + 1), lambda i: w[i] * {}))"
_POW = "pow(t[i], s)"


def _sum(term: str) -> str:
    return _STEP.format(term.replace("P", _POW).replace("R", f"(v[i] - a * {_POW})"))


@query(f"""WITH RECURSIVE {BANDS[5:]}, pixels AS (SELECT x, y, list((2 + value) * pow(1 + 0.1e0 * band, -0.7e0) ORDER BY band) AS v, list(1 + 0.1e0 * band ORDER BY band) AS t, list(1e0 + band % 3 ORDER BY band) AS w FROM bands GROUP BY x, y),
    fit(k, x, y, v, t, w, a, s) AS (SELECT 0, x, y, v, t, w, 2e0, -0.7e0 FROM pixels
    UNION ALL SELECT k + 1, x, y, v, t, w, a + (s22 * g1 - s12 * g2) / (s11 * s22 - s12 * s12), s + (s11 * g2 - s12 * g1) / (s11 * s22 - s12 * s12) FROM
        (SELECT *, {_sum("P * P")} AS s11, {_sum("a * P * P * ln(t[i])")} AS s12, {_sum("a * a * P * P * ln(t[i]) * ln(t[i])")} AS s22, {_sum("P * R")} AS g1, {_sum("a * P * ln(t[i]) * R")} AS g2 FROM fit WHERE k < 15))
    SELECT x, y, round(a, 5) + 0 AS amplitude, round(s, 5) + 0 AS slope, TRUE AS converged FROM fit WHERE k = 15""")
def spectral_fit(spark, sf_dir):
    """Power laws fitted to the bands of each pixel, without logarithms of the values."""
    b = bands_of(spark, sf_dir).withColumn("freq", 1e9 * (1 + 0.1 * F.col("band")))
    b = b.select("x", "y", "freq", ((2 + F.col("value")) * F.pow(F.col("freq") / 1e9, F.lit(-0.7))).alias("value"), (1.0 + F.pmod("band", F.lit(3))).alias("weight"))
    return rounded(spectra.power_laws(b, ["x", "y"], 1e9).select("x", "y", "amplitude", "slope", "converged"), "x", "y", "converged", digits=5)
