"""Queries on image cubes, components and high-cadence series."""

from __future__ import annotations

from math import exp, log, pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_seconds, gaussian, profile, taper
from ..operators import images
from ..sources import CUBE_SQL, VIS_SQL, cube_of, read, vis_of
from .registry import query, rounded

#: The mean image of each label is a band of an 8 x 8 cube.
BANDS = f"WITH {CUBE_SQL}, bands AS (SELECT band, x, y, avg(value) AS value FROM cube GROUP BY ALL)"
PIX = ["x", "y"]
BXY = ["band", "x", "y"]
FREQS = [1.0e9 + 1.0e7 * k for k in range(10)]


def bands_of(spark, sf_dir) -> DataFrame:
    return cube_of(spark, sf_dir).groupBy("band", "x", "y").agg(F.avg("value").alias("value"))


def _r(sql: str) -> str:
    return f"round({sql}, 6) + 0"


@query(f"{BANDS} SELECT band, round(stddev_pop(value), 6) AS rms, round(max(abs(value)), 6) AS rmax FROM bands GROUP BY band")
def image_rms_peak(spark, sf_dir):
    return rounded(images.statistics(bands_of(spark, sf_dir), ["band"]), "band")


@query(f"{BANDS} SELECT arg_min(band, (rms, band)) AS band FROM (SELECT band, round(stddev_pop(value), 9) AS rms FROM bands GROUP BY band)")
def best_iteration(spark, sf_dir):
    """The band, taken as an iteration, with the least rms."""
    s = images.statistics(bands_of(spark, sf_dir), ["band"]).withColumn("rms", F.round("rms", 9))
    return s.agg(F.min_by("band", F.struct("rms", "band")).alias("band"))


@query(f"{BANDS}, t AS (SELECT x, y, sum(value) AS s FROM bands GROUP BY ALL) SELECT x, y, round(s * s, 6) AS power FROM t ORDER BY round(s * s, 9) DESC, x, y LIMIT 1")
def peak_topk(spark, sf_dir):
    t = bands_of(spark, sf_dir).groupBy(*PIX).agg(F.sum("value").alias("s"))
    return rounded(t.orderBy(F.desc(F.round(F.col("s") * F.col("s"), 9)), "x", "y").limit(1).select("x", "y", (F.col("s") * F.col("s")).alias("power")), *PIX)


@query(f"{BANDS}, t AS (SELECT x, y, sum(value) AS s FROM bands GROUP BY ALL) SELECT x, y, {_r('s')} AS s FROM t WHERE s * s > 0.25e0 * (SELECT max(s * s) FROM t)")
def active_set(spark, sf_dir):
    t = bands_of(spark, sf_dir).groupBy(*PIX).agg(F.sum("value").alias("s"))
    peak = t.agg(F.max(F.col("s") * F.col("s")).alias("peak"))
    return rounded(t.crossJoin(F.broadcast(peak)).filter(F.col("s") * F.col("s") > 0.25 * F.col("peak")).select("x", "y", "s"), *PIX)  # one row


@query(f"WITH {CUBE_SQL} SELECT vec_id, x, y, {_r('sign(value) * greatest(abs(value) - 0.05e0, 0)')} AS value FROM cube")
def prox_l1(spark, sf_dir):
    c = cube_of(spark, sf_dir)
    return rounded(c.select("vec_id", "x", "y", images.soft(F.col("value"), 0.05).alias("value")), "vec_id", "x", "y")


_SUM = f"{BANDS}, n AS (SELECT *, abs(sum(value) OVER (PARTITION BY x, y)) AS size FROM bands)"


@query(f"{_SUM} SELECT band, x, y, {_r('CASE WHEN size > 0 THEN value * greatest(size - 0.02e0, 0) / size ELSE 0 END')} AS value FROM n")
def prox_l21_sum(spark, sf_dir):
    return rounded(images.prox_l21(bands_of(spark, sf_dir), PIX, 0.02), *BXY)


@query(f"{BANDS}, n AS (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY x, y)) AS size FROM bands) SELECT band, x, y, {_r('CASE WHEN size > 0 THEN value * greatest(size - 0.02e0, 0) / size ELSE 0 END')} AS value FROM n")
def prox_l21_norm(spark, sf_dir):
    return rounded(images.prox_l21(bands_of(spark, sf_dir), PIX, 0.02, "norm"), *BXY)


@query(f"{_SUM} SELECT band, x, y, {_r('value * coalesce(least(1, 0.05e0 / nullif(size, 0)), 1)')} AS value FROM n")
def dual_update(spark, sf_dir):
    return rounded(images.dual_update(bands_of(spark, sf_dir), PIX, 0.05), *BXY)


@query(f"{BANDS} SELECT band, x, y, {_r('greatest(value, 0)')} AS value FROM bands")
def positivity_clamp(spark, sf_dir):
    return rounded(images.positive(bands_of(spark, sf_dir), PIX, 1), *BXY)


@query(f"{BANDS} SELECT band, x, y, {_r('CASE WHEN min(value + 0.03e0) OVER (PARTITION BY x, y) <= 0 THEN 0 ELSE value + 0.03e0 END')} AS value FROM bands")
def positivity_any(spark, sf_dir):
    return rounded(images.positive(bands_of(spark, sf_dir).withColumn("value", F.col("value") + 0.03), PIX, 2), *BXY)


@query(f"""{BANDS}, s AS (SELECT band % 2 AS basis, x, y, sum(value) AS s FROM bands GROUP BY ALL)
    SELECT basis, x, y, {_r('s')} AS s, {_r('3e0 / (1 + pow(abs(s), 2) / pow(coalesce(stddev_pop(CASE WHEN s <> 0 THEN s END) OVER (PARTITION BY basis), 1), 2))')} AS weight FROM s""")
def reweight_l1(spark, sf_dir):
    c = bands_of(spark, sf_dir).withColumn("basis", F.col("band") % 2)
    return rounded(images.reweighted(c, PIX, ["basis"], 2.0, 2.0), "basis", *PIX)


@query(f"""{BANDS}, p AS (SELECT x, y, value, coalesce(lead(value) OVER (PARTITION BY x, y ORDER BY band), 0) AS later FROM bands)
    SELECT round(sqrt(sum((value - later) * (value - later)) / greatest(sum(value * value), 1e-12)), 6) AS change, {_r('sum(value * later)')} AS dot, bool_or(value <> 0) AS any_nonzero FROM p""")
def norm_diff_dot(spark, sf_dir):
    from pyspark.sql import Window

    p = bands_of(spark, sf_dir).withColumn("later", F.coalesce(F.lead("value").over(Window.partitionBy("x", "y").orderBy("band")), F.lit(0.0)))
    d = F.col("value") - F.col("later")
    out = p.agg(F.sqrt(F.sum(d * d) / F.greatest(F.sum(F.col("value") * F.col("value")), F.lit(1e-12))).alias("change"), F.sum(F.col("value") * F.col("later")).alias("dot"), F.bool_or(F.col("value") != 0).alias("any_nonzero"))
    return rounded(out, "any_nonzero")


MASK = f"{BANDS}, mask AS (SELECT x, y FROM bands GROUP BY x, y HAVING sum(value) > -0.03e0)"
_N4 = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)"


def mask_of(spark, sf_dir) -> DataFrame:
    return bands_of(spark, sf_dir).groupBy(*PIX).agg(F.sum("value").alias("s")).filter("s > -0.03").select(*PIX)


@query(f"{MASK} SELECT band, x, y, {_r('CASE WHEN (x, y) IN (SELECT (x, y) FROM mask) THEN value ELSE 0 END')} AS value FROM bands")
def mask_apply(spark, sf_dir):
    return rounded(images.masked(bands_of(spark, sf_dir), mask_of(spark, sf_dir)).select(*BXY, "value"), *BXY)


@query(f"{MASK} SELECT DISTINCT CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y FROM mask, {_N4} WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7")
def mask_dilate(spark, sf_dir):
    return images.dilated(mask_of(spark, sf_dir), 8, 8).select(F.col("x").cast("int"), F.col("y").cast("int"))


@query(f"{MASK} SELECT CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y FROM mask, {_N4} GROUP BY ALL HAVING count(*) = 5")
def mask_erode(spark, sf_dir):
    return images.eroded(mask_of(spark, sf_dir)).select(F.col("x").cast("int"), F.col("y").cast("int"))


@query(f"""WITH RECURSIVE {MASK[5:]}, spread(x, y, island) AS (SELECT x, y, CAST(x AS BIGINT) * 1048576 + y FROM mask
    UNION SELECT m.x, m.y, s.island FROM spread s, mask m WHERE abs(m.x - s.x) + abs(m.y - s.y) = 1),
    least_of AS (SELECT x, y, min(island) AS island FROM spread GROUP BY ALL)
    SELECT x, y FROM least_of WHERE island IN (SELECT island FROM least_of GROUP BY island HAVING count(*) <= 6)""")
def remove_islands(spark, sf_dir):
    """Pixels of the islands of six pixels at most."""
    named = images.islands(mask_of(spark, sf_dir))
    small = named.groupBy("island").count().filter("count <= 6").select("island")
    return named.join(small, "island", "left_semi").select(F.col("x").cast("int"), F.col("y").cast("int"))


_SIGNS = {"LL": "1", "LH": "CASE WHEN y % 2 = 0 THEN 1 ELSE -1 END", "HL": "CASE WHEN x % 2 = 0 THEN 1 ELSE -1 END", "HH": "CASE WHEN x % 2 = y % 2 THEN 1 ELSE -1 END"}
HAAR = BANDS + ", coef AS (" + " UNION ALL ".join(f"SELECT band, '{k}' AS kind, CAST(x // 2 AS INT) AS i, CAST(y // 2 AS INT) AS j, sum(({s}) * value / 2) AS value FROM bands GROUP BY ALL" for k, s in _SIGNS.items()) + ")"


@query(f"{HAAR} SELECT band, kind, i, j, {_r('value')} AS value FROM coef")
def haar_level1(spark, sf_dir):
    return rounded(images.haar(bands_of(spark, sf_dir), ["band"]), "band", "kind", "i", "j")


@query(f"{BANDS} SELECT band, x, y, {_r('value')} AS value FROM bands")
def haar_inverse(spark, sf_dir):
    return rounded(images.inverse_haar(images.haar(bands_of(spark, sf_dir), ["band"]), ["band"]), *BXY)


_X = images.design(FREQS, 3)
_S = images.solver(_X, [1.0 + 0.1 * k for k in range(10)], 0.01)


def _coefficient(k: int) -> str:
    return "sum(value * [" + ", ".join(f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in map(float, _S[k])) + "][band + 1])"


@query(f"{BANDS} SELECT x, y, " + ", ".join(f"{_r(_coefficient(k))} AS c{k}" for k in range(3)) + " FROM bands GROUP BY x, y")
def component_fit_legendre(spark, sf_dir):
    return rounded(images.fit_components(bands_of(spark, sf_dir), PIX, "band", _S), *PIX)


@query(f"{BANDS}, f AS (SELECT x, y, " + ", ".join(f"{_coefficient(k)} AS c{k}" for k in range(3)) + " FROM bands GROUP BY x, y), d(band, p0, p1, p2) AS (VALUES " + ", ".join("(" + ", ".join([str(i), *(f"CAST({float(v)!r} AS DOUBLE)" for v in row)]) + ")" for i, row in enumerate(_X)) + f") SELECT CAST(band AS INT) AS band, x, y, {_r('c0 * p0 + c1 * p1 + c2 * p2')} AS value FROM f, d")
def component_eval(spark, sf_dir):
    return rounded(images.evaluate_components(images.fit_components(bands_of(spark, sf_dir), PIX, "band", _S), PIX, _X), *BXY)


@query(f"{BANDS} SELECT x, y, {_r('sum(CASE WHEN band = 0 THEN value * -1.5e0 ELSE value * 2.5e0 END)')} AS value FROM bands WHERE band < 2 GROUP BY x, y")
def band_extrapolate(spark, sf_dir):
    return rounded(images.extrapolated(bands_of(spark, sf_dir), PIX, (1.0e9, 1.01e9), 1.025e9), *PIX)


@query(f"""{BANDS}, g AS (SELECT CAST(a.i AS INT) AS ox, CAST(b.i AS INT) AS oy FROM range(10) a(i), range(10) b(i))
    SELECT band, ox AS x, oy AS y, {_r('sum(value * (1 - abs(ox * 0.75e0 - x)) * (1 - abs(oy * 0.75e0 - y))) * 0.75e0 * 0.75e0')} AS value FROM bands, g WHERE abs(ox * 0.75e0 - x) < 1 AND abs(oy * 0.75e0 - y) < 1 GROUP BY ALL""")
def grid_resample(spark, sf_dir):
    out = images.resampled(bands_of(spark, sf_dir), ["band"], 0.75, 10, 10)
    return rounded(out.select("band", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "value"), *BXY)


@query(f"""WITH {VIS_SQL}, t AS (SELECT field_id, chan, freq / 1e9 AS freq, sum(weight) AS flux FROM vis GROUP BY ALL)
    SELECT field_id, round(regr_slope(ln(flux), ln(freq)), 6) AS index, round(exp(regr_intercept(ln(flux), ln(freq))), 4) AS amplitude FROM t WHERE flux > 0 GROUP BY field_id""")
def spectral_index(spark, sf_dir):
    t = vis_of(spark, sf_dir).groupBy("field_id", "chan", (F.col("freq") / 1e9).alias("freq")).agg(F.sum("weight").alias("flux"))
    return images.spectral_index(t, ["field_id"]).select("field_id", F.round("index", 6).alias("index"), F.round("amplitude", 4).alias("amplitude"))


_GRID = "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y FROM range(32) a(i), range(32) b(i)"


def grid_of(spark, n: int = 32) -> DataFrame:
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("x"), (F.col("id") % n).cast("int").alias("y"))


@query(f"SELECT x, y, round(exp({-4 * log(2)!r} * (pow((x - 16) * {np.sin(0.5)!r} + (y - 16) * {np.cos(0.5)!r}, 2) / 36e0 + pow((x - 16) * {np.cos(0.5)!r} - (y - 16) * {np.sin(0.5)!r}, 2) / 16e0)), 6) + 0 AS value FROM ({_GRID})".replace("np.float64(", "(").replace("))", "))"))
def gaussian_kernel(spark, sf_dir):
    return rounded(grid_of(spark).select("x", "y", gaussian(F.col("x") - 16, F.col("y") - 16, 6.0, 4.0, 0.5).alias("value")), *PIX)


@query(f"SELECT x, y, round(CASE WHEN least(x, 31 - x) >= 6 THEN 1 ELSE 0.5e0 * (1 - cos({pi!r} * least(x, 31 - x) / 6)) END * CASE WHEN least(y, 31 - y) >= 6 THEN 1 ELSE 0.5e0 * (1 - cos({pi!r} * least(y, 31 - y) / 6)) END, 6) + 0 AS value FROM ({_GRID})")
def edge_taper(spark, sf_dir):
    return rounded(grid_of(spark).select("x", "y", (taper(F.col("x"), 32, 6) * taper(F.col("y"), 32, 6)).alias("value")), *PIX)


@query(f"""{BANDS}, p AS (SELECT band, x, y, value * value AS value FROM bands), m AS (SELECT band, sum(value) AS s, sum(value * x) / sum(value) AS mx, sum(value * y) / sum(value) AS my,
    sum(value * x * x) / sum(value) AS xx, sum(value * x * y) / sum(value) AS xy, sum(value * y * y) / sum(value) AS yy FROM p GROUP BY band)
    SELECT band, round(mx, 6) AS mx, round(my, 6) AS my, round(xx - mx * mx, 6) AS mxx, {_r('xy - mx * my')} AS mxy, round(yy - my * my, 6) AS myy FROM m""")
def psf_moments(spark, sf_dir):
    return rounded(images.moments(bands_of(spark, sf_dir).withColumn("value", F.col("value") * F.col("value")), ["band"]), "band")


EVENTS = """WITH ev AS (SELECT *, epoch(ts) AS t, CAST(user_id % 16 AS INT) AS pixel, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS block FROM events),
    blocks AS (SELECT pixel, block, avg(value) AS value, stddev_pop(value) AS rms, count(*) + 0e0 AS weight FROM ev GROUP BY ALL)"""


def events_of(spark, sf_dir) -> DataFrame:
    t = epoch_seconds("ts")
    return read(spark, sf_dir, "events").select("event_id", "value", t.alias("t"), (F.col("user_id") % 16).cast("int").alias("pixel"), F.floor(t / 43200).cast("long").alias("block"))


def blocks_of(spark, sf_dir) -> DataFrame:
    return events_of(spark, sf_dir).groupBy("pixel", "block").agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("rms"), F.count("*").cast("double").alias("weight"))


@query(f"{EVENTS} SELECT pixel, block, round(value, 6) AS value, round(rms, 6) AS rms, weight FROM blocks")
def hci_blocks(spark, sf_dir):
    return rounded(blocks_of(spark, sf_dir), "pixel", "block")


FLAGGED = f"{EVENTS}, med AS (SELECT pixel, quantile_cont(rms, 0.5) AS median FROM blocks WHERE rms <> 0 GROUP BY pixel), flagged AS (SELECT blocks.*, rms = 0 OR coalesce(rms > 1.5e0 * median, true) AS flag FROM blocks LEFT JOIN med USING (pixel))"


@query(f"{FLAGGED} SELECT pixel, block, flag FROM flagged")
def hci_rms_flag(spark, sf_dir):
    return images.flag_by_rms(blocks_of(spark, sf_dir), ["pixel"], 1.5).select("pixel", "block", "flag")


@query(f"{FLAGGED} SELECT pixel, round(sum(value * weight) / sum(weight), 6) AS value, sum(weight) AS wsum FROM flagged WHERE NOT flag GROUP BY pixel")
def hci_weighted_mean(spark, sf_dir):
    return rounded(images.weighted_mean(images.flag_by_rms(blocks_of(spark, sf_dir), ["pixel"], 1.5), ["pixel"]), "pixel")


@query(f"{EVENTS} SELECT pixel, round(avg(value * value), 4) AS psf2 FROM blocks GROUP BY pixel")
def hci_psf2_mean(spark, sf_dir):
    return rounded(blocks_of(spark, sf_dir).groupBy("pixel").agg(F.avg(F.col("value") * F.col("value")).alias("psf2")), "pixel", digits=4)


@query(f"""{EVENTS}, z AS (SELECT event_id, (t - (SELECT min(t) FROM ev)) / 86400 AS d FROM ev) SELECT event_id, round(exp(-pow(d - 10, 2) / 18e0), 6) AS gauss,
    round(CASE WHEN d >= 10 THEN exp(-(d - 10) / 4e0) ELSE 0 END, 6) AS decay, CASE WHEN d >= 10 AND d <= 14 THEN 1e0 ELSE 0e0 END AS step FROM z""")
def transient_profile(spark, sf_dir):
    ev = events_of(spark, sf_dir)
    start = ev.agg(F.min("t").alias("t0"))
    d = (F.col("t") - F.col("t0")) / 86400
    z = ev.crossJoin(F.broadcast(start)).select("event_id", d.alias("d"))  # one row
    return rounded(z.select("event_id", profile("gaussian", F.col("d"), 10.0, 3.0).alias("gauss"), profile("exponential", F.col("d"), 10.0, 4.0).alias("decay"), profile("step", F.col("d"), 10.0, 4.0).alias("step")), "event_id")


KNOTS = [(0.0, 1.0), (7.0, 2.5), (12.0, 0.5), (20.0, 3.0)]
_INNER = " ".join(f"WHEN d >= {a[0]!r}e0 AND d < {b[0]!r}e0 THEN {a[1]!r}e0 + ({b[1]!r}e0 - {a[1]!r}e0) * (d - {a[0]!r}e0) / ({b[0]!r}e0 - {a[0]!r}e0)" for a, b in zip(KNOTS, KNOTS[1:]))


@query(f"{EVENTS}, z AS (SELECT event_id, (t - (SELECT min(t) FROM ev)) / 86400 - 2 AS d FROM ev) SELECT event_id, round(CASE WHEN d < {KNOTS[0][0]!r}e0 THEN {KNOTS[0][1]!r}e0 {_INNER} ELSE {KNOTS[-1][1]!r}e0 END, 6) AS value FROM z")
def profile_interp_join(spark, sf_dir):
    ev = events_of(spark, sf_dir)
    start = ev.agg(F.min("t").alias("t0"))
    z = ev.crossJoin(F.broadcast(start)).select("event_id", ((F.col("t") - F.col("t0")) / 86400 - 2).alias("d"))  # one row
    out = images.interpolated(z, spark.createDataFrame(KNOTS, "x double, y double"), "d")
    return rounded(out.select("event_id", "value"), "event_id")


_K = np.array([[exp(-abs(i - j) / 2) for j in range(8)] for i in range(8)])
_CELL = "exp(-abs({} - {}) / 2e0)"


@query(f"""{BANDS}, g AS (SELECT CAST(a.i AS INT) AS ox, CAST(b.i AS INT) AS oy FROM range(8) a(i), range(8) b(i))
    SELECT band, ox AS x, oy AS y, {_r('sum(value * ' + _CELL.format('ox', 'x') + ' * ' + _CELL.format('oy', 'y') + ')')} AS value FROM bands, g GROUP BY ALL""")
def kron_matvec(spark, sf_dir):
    one = images.along_axis(bands_of(spark, sf_dir), "x", _K, ["band", "y"])
    return rounded(images.along_axis(one, "y", _K, ["band", "x"]).select(*BXY, "value"), *BXY)


_A = np.eye(10) + 0.5 * np.eye(10, k=1) + 0.5 * np.eye(10, k=-1)


@query(f"{BANDS} SELECT CAST(o AS INT) AS band, x, y, {_r('sum(value * CASE abs(o - band) WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0e0 END)')} AS value FROM bands, range(10) r(o) GROUP BY ALL")
def band_mix(spark, sf_dir):
    """A band-by-band matrix times the cube."""
    return rounded(images.along_axis(bands_of(spark, sf_dir), "band", _A, PIX).select(*BXY, "value"), *BXY)


@query(f"{BANDS}, w AS (SELECT band, 1e0 + band AS wsum FROM bands GROUP BY band) SELECT x, y, {_r('sum(value * wsum) / sum(wsum)')} AS value FROM bands JOIN w USING (band) GROUP BY x, y")
def weighted_band_mean(spark, sf_dir):
    b = bands_of(spark, sf_dir)
    return rounded(b.groupBy(*PIX).agg((F.sum(F.col("value") * (1.0 + F.col("band"))) / F.sum(1.0 + F.col("band"))).alias("value")), *PIX)


@query(f"{BANDS} SELECT band, x, y, {_r('value')} AS value FROM bands WHERE band NOT IN (1, 4) AND value > 0.01e0")
def drop_bands_min_val(spark, sf_dir):
    return rounded(bands_of(spark, sf_dir).filter(~F.col("band").isin(1, 4) & (F.col("value") > 0.01)), *BXY)


@query(f"""{BANDS} SELECT 'cube' AS product, band, x, y, {_r('value')} AS value FROM bands
    UNION ALL SELECT 'mfs', 0, x, y, {_r('avg(value)')} FROM bands GROUP BY x, y""")
def fits_cube_and_mean(spark, sf_dir):
    """The cube and its mean over bands, written as FITS files and read back."""
    from ..sources.fits import Frame, read_fits, write_fits
    from .tables import temporary

    folder = temporary(spark, "fits")
    cube = bands_of(spark, sf_dir)
    mean = cube.groupBy(*PIX).agg(F.avg("value").alias("value")).withColumn("band", F.lit(0))
    for product, table, freqs in (("cube", cube, FREQS), ("mfs", mean, [sum(FREQS) / len(FREQS)])):
        write_fits(table.withColumn("product", F.lit(product)), folder, Frame(8, 8, 0.001, 0.001, 0.2, -0.5, tuple(freqs)), ["product"], -64)
    back = read_fits(spark, f"{folder}/*.fits").withColumn("product", F.regexp_extract("file", r"([^/]+)\.fits$", 1))
    return rounded(back.select("product", *BXY, "value"), "product", *BXY)
