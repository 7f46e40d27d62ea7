"""Queries on visibilities."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import C, image_size, unix_time
from ..operators import imaging, visibility, weighting, wgrid
from ..sources import VIS_SQL, read, vis_of
from .registry import query, rounded

#: Geometry of the queries' images and uv grids.
NX, CELL, GRID = 16, 1e-4, 64

W = f"WITH {VIS_SQL}"
#: Bands of two channels and time ids by year.
BT = f"{W}, bt AS (SELECT *, CAST((chan - 1) // 2 AS INT) AS band_id, CAST(floor(time / 31557600) - 22 AS INT) AS time_id FROM vis)"
_U, _V = f"(u * freq / {C}e0)", f"(v * freq / {C}e0)"
CELLS = f"""{BT}, folded AS (SELECT *, CASE WHEN {_V} < 0 THEN -1e0 ELSE 1e0 END AS sgn FROM bt),
    located AS (SELECT *, CAST(floor((sgn * {_U} + {1 / (2 * CELL)!r}) * {GRID * CELL!r}) AS INT) AS ui, CAST(floor((sgn * {_V} + {1 / (2 * CELL)!r}) * {GRID * CELL!r}) AS INT) AS vi FROM folded),
    celled AS (SELECT * REPLACE (CASE WHEN ui BETWEEN 0 AND {GRID - 1} AND vi BETWEEN 0 AND {GRID - 1} THEN ui END AS ui, CASE WHEN ui BETWEEN 0 AND {GRID - 1} AND vi BETWEEN 0 AND {GRID - 1} THEN vi END AS vi) FROM located),
    counts AS (SELECT band_id, ui, vi, sum(weight) AS cnt FROM celled WHERE NOT flag AND ui IS NOT NULL GROUP BY ALL)"""
PIXELS = f"pixels AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, (a.i - {NX // 2}) * {CELL!r} AS l, (b.i - {NX // 2}) * {CELL!r} AS m FROM range({NX}) a(i), range({NX}) b(i))"
PHASE = f"({2 * pi!r} * freq / {C}e0 * (u * l - v * m - w * (sqrt(1 - l * l - m * m) - 1)))"


def band_time(vis: DataFrame) -> DataFrame:
    return vis.withColumn("band_id", F.floor((F.col("chan") - 1) / 2).cast("int")).withColumn("time_id", (F.floor(F.col("time") / 31557600) - 22).cast("int"))


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighting.with_cells(band_time(vis_of(spark, sf_dir)), GRID, GRID, CELL)


def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighting.counts(celled(spark, sf_dir), ["band_id"])


@query(f"{W} SELECT row_id, time, chan, freq, re, im FROM vis WHERE field_id IN (0, 2) AND ddid IN (1) AND freq BETWEEN 1.02e9 AND 1.06e9 AND NOT (flag OR ant1 = ant2)")
def vis_select_partition_range(spark, sf_dir):
    good = visibility.select(vis_of(spark, sf_dir), fields=[0, 2], ddids=[1], freq_range="1.02e9:1.06e9").filter(~visibility.row_flag(F.col("flag")))
    return good.select("row_id", "time", "chan", "freq", "re", "im")


@query(f"{W} SELECT row_id, re - model_re AS re, im - model_im AS im FROM vis")
def vis_column_arithmetic(spark, sf_dir):
    return visibility.combined(vis_of(spark, sf_dir), "-").select("row_id", "re", "im")


@query(f"{W} SELECT row_id, round(coalesce(1 / (sigma * sigma), weight, 1e0), 6) AS weight FROM vis")
def vis_weight_from_sigma(spark, sf_dir):
    return rounded(vis_of(spark, sf_dir).select("row_id", visibility.weight_of(F.col("sigma"), F.col("weight")).alias("weight")), "row_id")


@query(f"{W} SELECT ant1, ant2, chan, NOT bool_or(flag) AS mask FROM vis GROUP BY ALL")
def vis_flag_mask(spark, sf_dir):
    return visibility.any_correlation_flagged(vis_of(spark, sf_dir), ["ant1", "ant2", "chan"])


@query(f"{W} SELECT * FROM (SELECT field_id, ant1, ant2, count(*) AS samples, CAST(count_if(NOT flag) AS BIGINT) AS good FROM vis GROUP BY ALL) WHERE good > 0")
def drop_fully_flagged_groups(spark, sf_dir):
    return visibility.without_flagged_groups(vis_of(spark, sf_dir), ["field_id", "ant1", "ant2"])


@query(f"{W} SELECT time, n, CAST(sum(n) OVER (ORDER BY time) - n AS BIGINT) AS start FROM (SELECT time, count(*) AS n FROM vis GROUP BY time)")
def time_bins_runlength(spark, sf_dir):
    return visibility.time_bins(vis_of(spark, sf_dir))


@query(f"{W} SELECT time, CAST((row_number() OVER (ORDER BY time) - 1) // 16 AS INT) AS block FROM (SELECT DISTINCT time FROM vis)")
def time_blocks_fixed_count(spark, sf_dir):
    return visibility.time_blocks(vis_of(spark, sf_dir), 16)


@query(f"{W} SELECT row_id, round(time + 3506716800e0 - 3506716800e0, 6) AS unix FROM vis")
def unix_times(spark, sf_dir):
    return rounded(vis_of(spark, sf_dir).select("row_id", unix_time(F.col("time") + 3506716800.0).alias("unix")), "row_id")


@query(f"{W} SELECT ant, CAST(row_number() OVER (ORDER BY ant) - 1 AS INT) AS index FROM (SELECT ant1 AS ant FROM vis UNION SELECT ant2 FROM vis)")
def antenna_dense_rank(spark, sf_dir):
    return visibility.dense_antennas(vis_of(spark, sf_dir))


@query(f"""{W} SELECT field_id, scan, round(mean_freq, 3) AS mean_freq, CAST(CASE WHEN abs(mean_freq - 1.02e9) <= abs(mean_freq - 1.04e9) AND abs(mean_freq - 1.02e9) <= abs(mean_freq - 1.06e9) THEN 0
    WHEN abs(mean_freq - 1.04e9) <= abs(mean_freq - 1.06e9) THEN 1 ELSE 2 END AS INT) AS band_id FROM (SELECT field_id, scan, avg(freq) AS mean_freq FROM vis GROUP BY ALL)""")
def band_nearest_assign(spark, sf_dir):
    chunks = vis_of(spark, sf_dir).groupBy("field_id", "scan").agg(F.avg("freq").alias("mean_freq"))
    return rounded(visibility.nearest_band(chunks, [1.02e9, 1.04e9, 1.06e9]), "field_id", "scan", "band_id", digits=3)


@query(f"""{W}, s AS (SELECT ant1, ddid, array_to_string(list_sort(list(DISTINCT chan)), ',') AS chans, count(DISTINCT chan) AS n FROM vis GROUP BY ALL)
    SELECT ant1, ddid, CAST(dense_rank() OVER (ORDER BY chans) - 1 AS INT) AS band_group, CAST(n AS INT) AS n_chan FROM s""")
def band_group_by_spectrum(spark, sf_dir):
    return visibility.bands_by_spectrum(vis_of(spark, sf_dir), ["ant1", "ddid"])


GAINS = "gains AS (SELECT CAST(s_suppkey % 16 AS INT) AS ant, avg(1 + s_acctbal / 50000) AS g_re, avg((s_nationkey - 12) / 100e0) AS g_im FROM supplier GROUP BY 1)"


def gains_of(spark, sf_dir) -> DataFrame:
    t = read(spark, sf_dir, "supplier")
    return t.groupBy((F.col("s_suppkey") % 16).cast("int").alias("ant")).agg(F.avg(1 + F.col("s_acctbal") / 50000).alias("g_re"), F.avg((F.col("s_nationkey") - 12) / 100.0).alias("g_im"))


@query(f"""{W}, {GAINS}, j AS (SELECT vis.*, p.g_re * q.g_re + p.g_im * q.g_im AS a, p.g_im * q.g_re - p.g_re * q.g_im AS b,
    weight * (p.g_re * p.g_re + p.g_im * p.g_im) * (q.g_re * q.g_re + q.g_im * q.g_im) AS cw FROM vis JOIN gains p ON p.ant = ant1 JOIN gains q ON q.ant = ant2)
    SELECT row_id, round((re * a + im * b) / (a * a + b * b), 6) + 0 AS c_re, round((im * a - re * b) / (a * a + b * b), 6) + 0 AS c_im, round(cw, 6) AS c_weight FROM j""")
def gain_apply_diag(spark, sf_dir):
    return rounded(visibility.apply_gains(vis_of(spark, sf_dir), gains_of(spark, sf_dir)).select("row_id", "c_re", "c_im", "c_weight"), "row_id")


@query(f"{W}, {GAINS} SELECT DISTINCT ant2 FROM vis WHERE ant2 NOT IN (SELECT ant FROM gains WHERE ant < 12)")
def gain_alignment(spark, sf_dir):
    from ..sources import check_alignment

    vis = vis_of(spark, sf_dir).select("ant2")
    return check_alignment(vis, gains_of(spark, sf_dir).filter("ant < 12").withColumnRenamed("ant", "ant2"), ["ant2"])


_PIVOT = ", ".join(f"coalesce(sum(weight * {p}) FILTER (corr = '{c}') / sum(weight) FILTER (corr = '{c}'), 0) AS {c.lower()}_{p}" for c in ("XX", "XY", "YX", "YY") for p in ("re", "im"))
_PIVOT += ", " + ", ".join(f"coalesce(sum(weight) FILTER (corr = '{c}'), 1) AS w_{c.lower()}" for c in ("XX", "XY", "YX", "YY"))
PIVOT = f"{W}, p AS (SELECT ant1, ant2, chan, {_PIVOT} FROM vis GROUP BY ALL)"
_KEYS = ["ant1", "ant2", "chan"]


def pivoted(spark, sf_dir) -> DataFrame:
    return visibility.by_correlation(vis_of(spark, sf_dir), _KEYS)


def _pairs(*names: str):
    return [(F.col(f"{n}_re"), F.col(f"{n}_im")) for n in names]


@query(f"""{PIVOT} SELECT ant1, ant2, chan, round((xx_re + yy_re) / 2, 6) + 0 AS i_re, round((xx_im + yy_im) / 2, 6) + 0 AS i_im, round((xx_re - yy_re) / 2, 6) + 0 AS q_re, round((xx_im - yy_im) / 2, 6) + 0 AS q_im,
    round((xy_re + yx_re) / 2, 6) + 0 AS u_re, round((xy_im + yx_im) / 2, 6) + 0 AS u_im, round((xy_im - yx_im) / 2, 6) + 0 AS v_re, round((yx_re - xy_re) / 2, 6) + 0 AS v_im FROM p""")
def stokes_from_corrs(spark, sf_dir):
    s = visibility.stokes(*_pairs("xx", "xy", "yx", "yy"))
    return rounded(pivoted(spark, sf_dir).select(*_KEYS, *(v.alias(f"{k}_{p}") for k, pair in s.items() for p, v in zip(("re", "im"), pair, strict=True))), *_KEYS)


@query(f"""{PIVOT} SELECT ant1, ant2, chan, round(xx_re + xy_re, 6) + 0 AS xx_re, round(xx_im + xy_im, 6) + 0 AS xx_im, round(yx_re - yy_im, 6) + 0 AS xy_re, round(yx_im + yy_re, 6) + 0 AS xy_im,
    round(yx_re + yy_im, 6) + 0 AS yx_re, round(yx_im - yy_re, 6) + 0 AS yx_im, round(xx_re - xy_re, 6) + 0 AS yy_re, round(xx_im - xy_im, 6) + 0 AS yy_im FROM p""")
def corrs_from_stokes(spark, sf_dir):
    """The pivoted columns taken as I, Q, U, V."""
    c = visibility.correlations(*_pairs("xx", "xy", "yx", "yy"))
    return rounded(pivoted(spark, sf_dir).select(*_KEYS, *(v.alias(f"{k}_{p}") for k, pair in c.items() for p, v in zip(("re", "im"), pair, strict=True))), *_KEYS)


@query(f"""{PIVOT} SELECT ant1, ant2, chan, round(w_xx * (1.1e0 * 0.9e0) * (1.1e0 * 0.9e0) + w_yy * (0.8e0 * 1.2e0) * (0.8e0 * 1.2e0), 6) AS w_i,
    round(w_xy * (1.1e0 * 1.2e0) * (1.1e0 * 1.2e0) + w_yx * (0.8e0 * 0.9e0) * (0.8e0 * 0.9e0), 6) AS w_u FROM p""")
def mueller_diag_stokes(spark, sf_dir):
    w = visibility.mueller_diagonal((1.1, 0.8), (0.9, 1.2), [F.col(f"w_{c}") for c in ("xx", "xy", "yx", "yy")])
    return rounded(pivoted(spark, sf_dir).select(*_KEYS, w[0].alias("w_i"), w[2].alias("w_u")), *_KEYS)


@query(f"""{W} SELECT ant1, ant2, CAST((chan - 1) // 3 AS INT) AS bin, round(sum(weight * re) / sum(weight), 6) + 0 AS re, round(sum(weight * im) / sum(weight), 6) + 0 AS im, round(sum(weight), 6) AS weight, round(avg(freq), 3) AS freq
    FROM vis WHERE NOT flag GROUP BY ALL""")
def channel_average_weighted(spark, sf_dir):
    out = visibility.average_channels(vis_of(spark, sf_dir), ["ant1", "ant2"], 3)
    return out.select("ant1", "ant2", "bin", *((F.round(c, 3 if c == "freq" else 6) + 0.0).alias(c) for c in ("re", "im", "weight", "freq")))


@query(f"{W} SELECT round(max(sqrt(u * u + v * v)), 6) AS longest, max(freq) AS highest, count(DISTINCT time) AS n_times, count(DISTINCT chan) AS n_chan FROM vis")
def max_baseline(spark, sf_dir):
    out = vis_of(spark, sf_dir).agg(F.max(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).alias("longest"), F.max("freq").alias("highest"), F.countDistinct("time").alias("n_times"), F.countDistinct("chan").alias("n_chan"))
    return out.withColumn("longest", F.round("longest", 6))


_SIZES = " * ".join(f"pow({p}, e{p})" for p in (2, 3, 5, 7, 11))
_POWERS = ", ".join(f"range({n}) r{p}(e{p})" for p, n in ((2, 24), (3, 12), (5, 9), (7, 7), (11, 6)))


@query(f"""{W}, need AS (SELECT 1 / (2 * round(max(sqrt(u * u + v * v)), 6) * max(freq) / {C}e0) / 2 AS cell FROM vis),
    sizes AS (SELECT 2 * {_SIZES} AS n FROM {_POWERS})
    SELECT CAST(min(n) AS INT) AS npix, round(cell, 12) AS cell_rad FROM need, sizes WHERE n >= {pi!r} / 180 / cell GROUP BY cell""")
def image_geometry(spark, sf_dir):
    """Pixels and cell from the longest baseline and the highest frequency."""
    row = max_baseline(spark, sf_dir).first()
    npix, cell = image_size(row["longest"], row["highest"], 1.0)
    return spark.createDataFrame([(npix, round(cell, 12))], "npix int, cell_rad double")


@query(f"{CELLS} SELECT band_id, ui, vi, round(cnt, 6) AS cnt FROM counts")
def uv_counts(spark, sf_dir):
    return rounded(band_counts(spark, sf_dir), "band_id", "ui", "vi")


def _grouped(name: str, grouping: str) -> None:
    keys = weighting.GROUPINGS[grouping]
    head = "".join(f"{k}, " for k in keys)

    def run(spark, sf_dir):
        cells = weighting.counts(celled(spark, sf_dir), ["band_id", "time_id"])
        return rounded(weighting.regrouped(cells, grouping), *keys, "ui", "vi")

    run.__name__ = name
    query(f"{CELLS} SELECT {head}ui, vi, round(sum(weight), 6) AS cnt FROM celled WHERE NOT flag AND ui IS NOT NULL GROUP BY ALL")(run)


for _name, _by in (("uv_counts_per_band_time", "per-band-time"), ("uv_counts_per_time", "per-time"), ("uv_counts_per_band", "per-band"), ("uv_counts_mfs", "mfs")):
    _grouped(_name, _by)


@query(f"{CELLS} SELECT band_id, ui, vi, round(greatest(cnt, (SELECT quantile_cont(cnt, 0.5) / 2 FROM counts WHERE cnt > 0)), 6) AS cnt FROM counts")
def uv_counts_floor(spark, sf_dir):
    return rounded(weighting.floored(band_counts(spark, sf_dir), 2.0), "band_id", "ui", "vi")


_STEPS = "(SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy)"
BOX = f"boxed AS (SELECT band_id, CAST(ui + dx AS INT) AS ui, CAST(vi + dy AS INT) AS vi, sum(cnt) AS cnt FROM counts, {_STEPS} WHERE ui + dx BETWEEN 0 AND {GRID - 1} AND vi + dy BETWEEN 0 AND {GRID - 1} GROUP BY ALL)"


@query(f"{CELLS}, {BOX} SELECT band_id, ui, vi, round(cnt, 6) AS cnt FROM boxed")
def uv_counts_box(spark, sf_dir):
    return rounded(weighting.box_sums(band_counts(spark, sf_dir), 1, ["band_id"], GRID, GRID), "band_id", "ui", "vi")


@query(f"{BT} SELECT row_id, round(weight, 6) AS weight FROM bt")
def weights_natural(spark, sf_dir):
    return rounded(weighting.imaging_weights(band_time(vis_of(spark, sf_dir)), GRID, GRID, CELL, None, ["band_id"]).select("row_id", "weight"), "row_id")


@query(f"{CELLS} SELECT row_id, round(CASE WHEN cnt > 0 THEN weight / cnt ELSE weight END, 6) AS weight FROM celled LEFT JOIN counts USING (band_id, ui, vi)")
def weights_uniform(spark, sf_dir):
    return rounded(weighting.imaging_weights(band_time(vis_of(spark, sf_dir)), GRID, GRID, CELL, -2.0, ["band_id"]).select("row_id", "weight"), "row_id")


def _scaled(source: str, robust: float) -> str:
    return f"scaled AS (SELECT band_id, ui, vi, cnt * ssq + 1 AS cnt FROM {source} JOIN (SELECT band_id, {(5 * 10 ** (-robust)) ** 2!r} * sum(cnt) / sum(cnt * cnt) AS ssq FROM {source} GROUP BY band_id) USING (band_id))"


@query(f"{CELLS}, {_scaled('counts', 0.0)} SELECT row_id, round(CASE WHEN cnt > 0 THEN weight / cnt ELSE weight END, 6) AS weight FROM celled LEFT JOIN scaled USING (band_id, ui, vi)")
def weights_briggs(spark, sf_dir):
    return rounded(weighting.imaging_weights(band_time(vis_of(spark, sf_dir)), GRID, GRID, CELL, 0.0, ["band_id"]).select("row_id", "weight"), "row_id")


@query(f"{CELLS}, {BOX}, {_scaled('boxed', 0.5)} SELECT row_id, round(CASE WHEN cnt > 0 THEN weight / cnt ELSE weight END, 6) AS weight FROM celled LEFT JOIN scaled USING (band_id, ui, vi)")
def weights_super_robust(spark, sf_dir):
    return rounded(weighting.imaging_weights(band_time(vis_of(spark, sf_dir)), GRID, GRID, CELL, 0.5, ["band_id"], box=1).select("row_id", "weight"), "row_id")


@query(f"""{W}, g AS (SELECT *, re * re + im * im AS p FROM vis WHERE NOT flag), n AS (SELECT corr, avg(weight * p) AS s2 FROM g GROUP BY corr)
    SELECT row_id, round(CASE WHEN flag THEN weight ELSE weight * 7 / (5 + weight * (re * re + im * im) / s2) END, 6) AS weight FROM vis LEFT JOIN n USING (corr)""")
def l2_reweight_grid(spark, sf_dir):
    return rounded(weighting.student_weights(vis_of(spark, sf_dir), 5.0, "grid").select("row_id", "weight"), "row_id")


@query(f"""{W}, g AS (SELECT *, re * re + im * im AS p FROM vis WHERE NOT flag)
    SELECT row_id, round(CASE WHEN flag THEN weight ELSE 6e0 / (5 + (re * re + im * im) / s2) / s2 END, 6) AS weight FROM vis, (SELECT avg(p) AS s2 FROM g)""")
def l2_reweight_hci(spark, sf_dir):
    return rounded(weighting.student_weights(vis_of(spark, sf_dir), 5.0, "hci").select("row_id", "weight"), "row_id")


@query(f"{BT} SELECT band_id, time_id, round(sum(weight), 6) AS wsum FROM bt WHERE NOT flag GROUP BY ALL")
def weight_sums(spark, sf_dir):
    return rounded(imaging.weight_sums(band_time(vis_of(spark, sf_dir)), ["band_id", "time_id"]), "band_id", "time_id")


DIRTY = f"sum(weight * (re * cos{PHASE} - im * sin{PHASE}))"


@query(f"{W}, {PIXELS} SELECT x, y, round({DIRTY} / sum(weight), 6) + 0 AS value FROM vis, pixels WHERE NOT flag GROUP BY x, y")
def dirty_image(spark, sf_dir):
    vis = vis_of(spark, sf_dir)
    return rounded(imaging.normalised(imaging.direct_image(vis, NX, NX, CELL), imaging.weight_sums(vis)), "x", "y")


@query(f"""{CELLS}, {_scaled('counts', 0.0)}, {PIXELS}, weighted AS (SELECT * REPLACE (CASE WHEN cnt > 0 THEN weight / cnt ELSE weight END AS weight) FROM celled LEFT JOIN scaled USING (band_id, ui, vi))
    SELECT x, y, round({DIRTY} / sum(weight), 6) + 0 AS value FROM weighted, pixels WHERE NOT flag GROUP BY x, y""")
def dirty_image_briggs(spark, sf_dir):
    vis = weighting.imaging_weights(band_time(vis_of(spark, sf_dir)), GRID, GRID, CELL, 0.0, ["band_id"])
    return rounded(imaging.normalised(imaging.direct_image(vis, NX, NX, CELL), imaging.weight_sums(vis)), "x", "y")


@query(f"{W}, {PIXELS} SELECT x, y, round(sum(weight * cos{PHASE}) / sum(weight), 6) + 0 AS value FROM vis, pixels WHERE NOT flag GROUP BY x, y")
def psf_image(spark, sf_dir):
    vis = vis_of(spark, sf_dir)
    return rounded(imaging.normalised(imaging.direct_image(vis, NX, NX, CELL, value="psf"), imaging.weight_sums(vis)), "x", "y")


@query(f"{W}, {PIXELS.replace('AS l,', '+ 0.003e0 AS l,').replace('AS m FROM', '- 0.002e0 AS m FROM')} SELECT x, y, round({DIRTY} / sum(weight), 6) + 0 AS value FROM vis, pixels WHERE NOT flag GROUP BY x, y")
def dirty_offcentre(spark, sf_dir):
    vis = vis_of(spark, sf_dir)
    return rounded(imaging.normalised(imaging.direct_image(vis, NX, NX, CELL, l0=0.003, m0=-0.002), imaging.weight_sums(vis)), "x", "y")


@query(f"{BT}, {PIXELS} SELECT band_id, x, y, round({DIRTY} / sum(weight), 6) + 0 AS value FROM bt, pixels WHERE NOT flag GROUP BY band_id, x, y")
def dirty_cube(spark, sf_dir):
    vis = band_time(vis_of(spark, sf_dir))
    return rounded(imaging.normalised(imaging.direct_image(vis, NX, NX, CELL, ["band_id"]), imaging.weight_sums(vis, ["band_id"]), ["band_id"]), "band_id", "x", "y")


@query(f"{BT}, {PIXELS} SELECT x, y, round({DIRTY} / sum(weight), 6) + 0 AS value FROM bt, pixels WHERE NOT flag GROUP BY x, y")
def mfs_image(spark, sf_dir):
    vis = band_time(vis_of(spark, sf_dir))
    return rounded(imaging.mfs(imaging.direct_image(vis, NX, NX, CELL, ["band_id"]), imaging.weight_sums(vis, ["band_id"])), "x", "y")


COMPONENTS = [(8, 8, 0.5), (3, 11, 0.2), (12, 5, -0.1)]
_COMPS = "comps(cx, cy, flux) AS (VALUES " + ", ".join(f"({x}, {y}, {v!r}e0)" for x, y, v in COMPONENTS) + ")"
_CPHASE = PHASE.replace("u * l", "u * cl").replace("v * m", "v * cm").replace("l * l - m * m", "cl * cl - cm * cm")
MODEL = f"{_COMPS}, placed AS (SELECT (cx - {NX // 2}) * {CELL!r} AS cl, (cy - {NX // 2}) * {CELL!r} AS cm, flux FROM comps)"


# row_id repeats where two lines of an order have one number, so samples are numbered here
_SAMPLES = "samples AS (SELECT *, row_number() OVER () AS sample FROM vis)"


@query(f"{W}, {MODEL}, {_SAMPLES} SELECT any_value(row_id) AS row_id, round(sum(flux * cos{_CPHASE}), 6) + 0 AS p_re, round(-sum(flux * sin{_CPHASE}), 6) + 0 AS p_im FROM samples, placed GROUP BY sample")
def predict_components(spark, sf_dir):
    comps = spark.createDataFrame(COMPONENTS, "x int, y int, value double")
    return rounded(imaging.predict(vis_of(spark, sf_dir).select("row_id", "u", "v", "w", "freq"), comps, NX, NX, CELL).select("row_id", "p_re", "p_im"), "row_id")


@query(f"""{W}, {MODEL}, {PIXELS}, {_SAMPLES}, p AS (SELECT any_value(u) AS u, any_value(v) AS v, any_value(w) AS w, any_value(freq) AS freq, any_value(weight) AS weight,
    any_value(re) - sum(flux * cos{_CPHASE}) AS re, any_value(im) + sum(flux * sin{_CPHASE}) AS im FROM samples, placed WHERE NOT flag GROUP BY sample)
    SELECT x, y, round({DIRTY} / sum(weight), 6) + 0 AS value FROM p, pixels GROUP BY x, y""")
def residual_image(spark, sf_dir):
    vis = vis_of(spark, sf_dir)
    comps = spark.createDataFrame(COMPONENTS, "x int, y int, value double")
    return rounded(imaging.normalised(imaging.residual(vis, comps, NX, NX, CELL), imaging.weight_sums(vis)), "x", "y")


_WIDE = PIXELS.replace("pixels AS", "wide AS").replace(f"range({NX})", f"range({2 * NX})").replace(f"- {NX // 2})", f"- {NX})")


@query(f"""{BT}, {MODEL}, {PIXELS}, {_WIDE}, {_SAMPLES.replace("FROM vis", "FROM bt")},
    p AS (SELECT any_value(band_id) AS band_id, any_value(u) AS u, any_value(v) AS v, any_value(w) AS w, any_value(freq) AS freq, any_value(weight) AS weight, any_value(re) AS re, any_value(im) AS im,
    any_value(re) - sum(flux * cos{_CPHASE}) AS rest_re, any_value(im) + sum(flux * sin{_CPHASE}) AS rest_im FROM samples, placed WHERE NOT flag GROUP BY sample)
    SELECT band_id, 'dirty' AS product, x, y, round({DIRTY} / sum(weight), 6) + 0 AS value FROM p, pixels GROUP BY band_id, x, y
    UNION ALL SELECT band_id, 'residual', x, y, round({DIRTY.replace("* (re", "* (rest_re").replace("im *", "rest_im *")} / sum(weight), 6) + 0 FROM p, pixels GROUP BY band_id, x, y
    UNION ALL SELECT band_id, 'psf', x, y, round(sum(weight * cos{PHASE}) / sum(weight), 6) + 0 FROM p, wide GROUP BY band_id, x, y""")
def image_data_products(spark, sf_dir):
    """Dirty images, PSFs of twice the size and residuals of each band, from one scan."""
    comps = spark.createDataFrame(COMPONENTS, "x int, y int, value double")
    out = imaging.data_products(band_time(vis_of(spark, sf_dir)), NX, NX, CELL, ["band_id"], comps)
    return rounded(out.select("band_id", "product", "x", "y", "value"), "band_id", "product", "x", "y")


@query(f"{W}, {PIXELS} SELECT x, y, round(sum(weight * (re * cos{PHASE.replace('w * (', '0 * (')} - im * sin{PHASE.replace('w * (', '0 * (')})) / sum(weight), 4) + 0 AS value FROM vis, pixels WHERE NOT flag GROUP BY x, y")
def gridded_dirty_image(spark, sf_dir):
    """The kernel gridder, to the four digits that it must agree to with the exact sum."""
    vis = vis_of(spark, sf_dir)
    return rounded(imaging.normalised(imaging.gridded_image(vis, NX, NX, CELL, width=12), imaging.weight_sums(vis)), "x", "y", digits=4)


#: A field so wide that the w term turns phases by radians.
WIDE_CELL = 0.01
_WIDE_PIXELS, _WIDE_MODEL = (x.replace(f"* {CELL!r} AS", f"* {WIDE_CELL!r} AS") for x in (PIXELS, MODEL))


@query(f"{BT}, {_WIDE_PIXELS} SELECT band_id, x, y, round({DIRTY} / sum(weight), 5) + 0 AS value FROM bt, pixels WHERE NOT flag GROUP BY band_id, x, y")
def wide_field_image(spark, sf_dir):
    """The gridder with planes of w, for each band, to five digits of the exact sum."""
    vis = band_time(vis_of(spark, sf_dir))
    image = wgrid.image(vis, wgrid.Geometry(NX, NX, WIDE_CELL, 12, 16), ["band_id"])
    return rounded(imaging.normalised(image, imaging.weight_sums(vis, ["band_id"]), ["band_id"]), "band_id", "x", "y", digits=5)


@query(f"{W}, {_WIDE_MODEL}, {_SAMPLES} SELECT any_value(row_id) AS row_id, round(sum(flux * cos{_CPHASE}), 5) + 0 AS p_re, round(-sum(flux * sin{_CPHASE}), 5) + 0 AS p_im FROM samples, placed GROUP BY sample")
def wide_field_predict(spark, sf_dir):
    """A model's visibilities from planes of w, to five digits of the exact sum."""
    model = spark.createDataFrame(COMPONENTS, "x int, y int, value double")
    vis = vis_of(spark, sf_dir).select("row_id", "u", "v", "w", "freq")
    return rounded(wgrid.degridded(vis, model, wgrid.Geometry(NX, NX, WIDE_CELL, 12, 16)).select("row_id", "p_re", "p_im"), "row_id", digits=5)


@query(f"{W}, r AS (SELECT *, 0.002e0 AS l, -0.001e0 AS m FROM vis) SELECT row_id, round(re * cos{PHASE} - im * sin{PHASE}, 6) + 0 AS re, round(re * sin{PHASE} + im * cos{PHASE}, 6) + 0 AS im FROM r")
def rephase_vis(spark, sf_dir):
    return rounded(visibility.rephase(vis_of(spark, sf_dir), 0.002, -0.001).select("row_id", "re", "im"), "row_id")


_M = visibility.rotation((0.0, 0.6, 0.8), 0.3)


@query(f"{W} SELECT row_id, " + ", ".join(f"round({_M[i][0]!r} * u + {_M[i][1]!r} * v + {_M[i][2]!r} * w, 6) + 0 AS {c}" for i, c in enumerate("uvw")) + " FROM vis")
def uvw_rotate(spark, sf_dir):
    return rounded(visibility.rotate_uvw(vis_of(spark, sf_dir), _M).select("row_id", "u", "v", "w"), "row_id")


@query(f"""{W}, r AS (SELECT *, 0.001e0 AS l, 0.002e0 AS m, 1.5e0 * pow(freq / 1e9, -0.7e0) AS s FROM vis) SELECT row_id, round(re + s * cos{PHASE}, 6) + 0 AS re, round(im - s * sin{PHASE}, 6) + 0 AS im FROM r""")
def inject_source(spark, sf_dir):
    from ..functions import spectrum

    return rounded(visibility.inject(vis_of(spark, sf_dir), 0.001, 0.002, spectrum(F.col("freq"), 1.5, 1e9, -0.7)).select("row_id", "re", "im"), "row_id")


@query(f"{W} SELECT field_id, scan, round(sum(re) - sum(model_re), 6) + 0 AS re, round(sum(im) - sum(model_im), 6) + 0 AS im FROM vis GROUP BY ALL")
def model_subtracted_sums(spark, sf_dir):
    return rounded(visibility.combined(vis_of(spark, sf_dir), "-").groupBy("field_id", "scan").agg(F.sum("re").alias("re"), F.sum("im").alias("im")), "field_id", "scan")


@query(f"""{W}, t AS (SELECT *, freq / {C}e0 * coalesce(sqrt(pow(u - lag(u) OVER b, 2) + pow(v - lag(v) OVER b, 2) + pow(w - lag(w) OVER b, 2)), 0) AS moved FROM vis WHERE NOT flag WINDOW b AS (PARTITION BY ant1, ant2, chan ORDER BY time, row_id))
    SELECT ant1, ant2, chan, count(*) AS samples, round(sum(moved), 4) AS path FROM t GROUP BY ALL""")
def baseline_tracks(spark, sf_dir):
    """Length of each baseline's uv track in wavelengths, on which baseline-dependent averaging rests."""
    moved = visibility.tracks(vis_of(spark, sf_dir))
    out = moved.groupBy("ant1", "ant2", "chan").agg(F.count("*").alias("samples"), F.sum("moved").alias("path"))
    return out.withColumn("path", F.round("path", 4))


#: Samples lose a tenth at the edge of a field of 1e-3 radians: sin(pi x) = 0.9 pi x at this x.
_TURNS = 0.25040899912669934

_W_MEANS = ", ".join(f"round(sum(weight * {c}) / sum(weight), 5) + 0 AS {c}" for c in ("re", "im", "u", "v", "w"))


@query(f"""{W}, t AS (SELECT *, freq / {C}e0 * coalesce(sqrt(pow(u - lag(u) OVER b, 2) + pow(v - lag(v) OVER b, 2) + pow(w - lag(w) OVER b, 2)), 0) AS moved FROM vis WHERE NOT flag WINDOW b AS (PARTITION BY ant1, ant2, chan ORDER BY time, row_id)),
    p AS (SELECT *, CAST(floor(sum(moved) OVER (PARTITION BY ant1, ant2, chan ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) / ({_TURNS!r} / 5e-4)) AS BIGINT) AS bin FROM t)
    SELECT ant1, ant2, chan, bin, {_W_MEANS}, round(sum(weight * time) / sum(weight), 2) AS time, round(sum(weight), 5) AS weight, count(*) AS samples FROM p GROUP BY ant1, ant2, chan, bin""")
def baseline_dependent_average(spark, sf_dir):
    keys = ("ant1", "ant2", "chan", "bin", "samples")
    out = visibility.average_baselines(vis_of(spark, sf_dir), 0.9, 1e-3)
    return rounded(out.withColumn("time", F.round("time", 2)), *keys, "time", digits=5)


@query("""WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
    r AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, count(*) AS n, round(sum(value), 6) + 0 AS total FROM r GROUP BY user_id, run""")
def session_statistics(spark, sf_dir):
    """Runs of a user's events less than an hour apart."""
    from ..streaming import session_statistics as of

    runs = of(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "1 hour")
    # the table's times have no zone, so the session's must not matter
    seconds = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")
    return rounded(runs.select("user_id", seconds("start").alias("start"), seconds("last").alias("last"), "n", "total"), "user_id", "start", "last", "n")
