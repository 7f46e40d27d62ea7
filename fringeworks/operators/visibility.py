"""Selection, arithmetic, flags, time and band bookkeeping, gains and Stokes."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import C, abs2, cdiv, cmul, conj, phasor, uvw_phase


def select(vis: DataFrame, fields=None, ddids=None, scans=None, freq_range: str | None = None) -> DataFrame:
    """Partition predicates, and a frequency range "lo:hi", inclusive, either side open."""
    for column, keep in (("field_id", fields), ("ddid", ddids), ("scan", scans)):
        if keep is not None:
            vis = vis.filter(F.col(column).isin(*keep))
    lo, _, hi = (freq_range or ":").partition(":")
    if lo:
        vis = vis.filter(F.col("freq") >= float(lo))
    return vis.filter(F.col("freq") <= float(hi)) if hi else vis


def row_flag(flag: Column | None = None) -> Column:
    """Autocorrelations are flagged along with what is flagged already."""
    auto = F.col("ant1") == F.col("ant2")
    return auto if flag is None else flag | auto


def combined(vis: DataFrame, sign: str) -> DataFrame:
    """DATA + or - MODEL."""
    s = {"+": 1.0, "-": -1.0}[sign]
    return vis.withColumn("re", F.col("re") + s * F.col("model_re")).withColumn("im", F.col("im") + s * F.col("model_im"))


def weight_of(sigma: Column | None = None, weight: Column | None = None) -> Column:
    """1 / sigma**2 where there is a sigma, else the weight column, else 1."""
    options = [*([1 / (sigma * sigma)] if sigma is not None else []), *([weight] if weight is not None else []), F.lit(1.0)]
    return F.coalesce(*options)


def any_correlation_flagged(vis: DataFrame, keys: list[str]) -> DataFrame:
    """mask: no correlation of a sample is flagged."""
    return vis.groupBy(*keys).agg((~F.bool_or("flag")).alias("mask"))


def without_flagged_groups(vis: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that have an unflagged sample, with their counts."""
    return vis.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(~F.col("flag")).alias("good")).filter("good > 0")


#: Seconds of a stretch of times that is put in order as one.
STRETCH = 86400.0


def _before(times: DataFrame, n: Column) -> DataFrame:
    """``before``: the sum of n over all earlier times.

    Times are put in order within stretches of a day, in as many tasks as there are
    days; only the days' sums, a row each, are put in order together.
    """
    cut = times.withColumns({"_stretch": F.floor(F.col("time") / STRETCH), "_n": n})
    days = cut.groupBy("_stretch").agg(F.sum("_n").alias("_all"))
    days = days.select("_stretch", (F.sum("_all").over(Window.orderBy("_stretch")) - F.col("_all")).alias("_earlier"))
    inside = F.sum("_n").over(Window.partitionBy("_stretch").orderBy("time")) - F.col("_n")
    return cut.withColumn("_inside", inside).join(days, "_stretch").withColumn("before", F.col("_inside") + F.col("_earlier")).drop("_stretch", "_n", "_inside", "_earlier")


def time_bins(vis: DataFrame) -> DataFrame:
    """Run-length index of the times: first row and number of rows of each; null times are left out."""
    bins = vis.filter("time IS NOT NULL").groupBy("time").agg(F.count("*").alias("n"))
    return _before(bins, F.col("n")).withColumnRenamed("before", "start")


def time_blocks(times: DataFrame, per_block: int) -> DataFrame:
    """Blocks of ``per_block`` distinct times in order; null times are left out."""
    each = times.select("time").filter("time IS NOT NULL").distinct()
    return _before(each, F.lit(1)).select("time", F.floor(F.col("before") / per_block).cast("int").alias("block"))


def dense_antennas(vis: DataFrame) -> DataFrame:
    """Antennas in use, renumbered from 0 in order."""
    used = vis.select(F.explode(F.array("ant1", "ant2")).alias("ant")).distinct()
    return used.withColumn("index", (F.row_number().over(Window.orderBy("ant")) - 1).cast("int"))


def nearest_band(chunks: DataFrame, bands: list[float]) -> DataFrame:
    """Output band nearest to a chunk's mean frequency; the first of equally near ones."""
    options = F.array(*(F.struct(F.abs(F.col("mean_freq") - f).alias("apart"), F.lit(i).alias("band_id")) for i, f in enumerate(bands)))
    return chunks.withColumn("band_id", F.array_min(options)["band_id"])


def bands_by_spectrum(vis: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with the same channels share a band group."""
    spectra = vis.groupBy(*keys).agg(F.array_sort(F.collect_set("chan")).alias("chans"))
    groups = spectra.select("chans").distinct().withColumn("band_group", (F.row_number().over(Window.orderBy(F.col("chans").cast("string"))) - 1).cast("int"))
    return spectra.join(groups, "chans").select(*keys, "band_group", F.size("chans").cast("int").alias("n_chan"))


def apply_gains(vis: DataFrame, gains: DataFrame) -> DataFrame:
    """Corrected visibilities V / (g_p conj(g_q)) and weights w |g_p|^2 |g_q|^2, for diagonal gains by antenna.

    gains: ant, g_re, g_im.  A row for each antenna, so Spark may broadcast it.
    """
    side = lambda a, p: gains.select(F.col("ant").alias(a), F.col("g_re").alias(f"{p}_re"), F.col("g_im").alias(f"{p}_im"))
    both = vis.join(side("ant1", "p"), "ant1").join(side("ant2", "q"), "ant2")
    p, q = (F.col("p_re"), F.col("p_im")), (F.col("q_re"), F.col("q_im"))
    re, im = cdiv((F.col("re"), F.col("im")), cmul(p, conj(q)))
    return both.withColumns({"c_re": re, "c_im": im, "c_weight": F.col("weight") * abs2(p) * abs2(q)})


def stokes(xx, xy, yx, yy, half: bool = True) -> dict[str, tuple[Column, Column]]:
    """I, Q, U, V of linear correlations, as complex pairs; without ``half`` as plain sums."""
    s = 0.5 if half else 1.0
    add = lambda a, b: (s * (a[0] + b[0]), s * (a[1] + b[1]))
    sub = lambda a, b: (s * (a[0] - b[0]), s * (a[1] - b[1]))
    d = sub(xy, yx)
    return {"i": add(xx, yy), "q": sub(xx, yy), "u": add(xy, yx), "v": (d[1], -d[0])}


def correlations(i, q, u, v) -> dict[str, tuple[Column, Column]]:
    """XX = I+Q, XY = U+iV, YX = U-iV, YY = I-Q of complex Stokes pairs."""
    iv = (-v[1], v[0])
    return {"xx": (i[0] + q[0], i[1] + q[1]), "xy": (u[0] + iv[0], u[1] + iv[1]), "yx": (u[0] - iv[0], u[1] - iv[1]), "yy": (i[0] - q[0], i[1] - q[1])}


def by_correlation(vis: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with the weighted mean of every correlation; a missing one is 0 with weight 1."""
    out = []
    for c in ("XX", "XY", "YX", "YY"):
        w = F.sum(F.when(F.col("corr") == c, F.col("weight")))
        for part in ("re", "im"):
            out.append(F.coalesce(F.sum(F.when(F.col("corr") == c, F.col("weight") * F.col(part))) / w, F.lit(0.0)).alias(f"{c.lower()}_{part}"))
        out.append(F.coalesce(w, F.lit(1.0)).alias(f"w_{c.lower()}"))
    return vis.groupBy(*keys).agg(*out)


def mueller_diagonal(p: tuple[float, float], q: tuple[float, float], weights: list[Column]) -> list[Column]:
    """Weights of I, Q, U, V under diagonal gains p and q (real): the diagonal of T^H M^H W M T."""
    g = [p[0] * q[0], p[0] * q[1], p[1] * q[0], p[1] * q[1]]
    w = [weights[k] * (g[k] * g[k]) for k in range(4)]
    return [w[0] + w[3], w[0] + w[3], w[1] + w[2], w[1] + w[2]]


def average_channels(vis: DataFrame, keys: list[str], per_bin: int) -> DataFrame:
    """Weighted mean of the unflagged samples of ``per_bin`` channels; frequencies by plain mean."""
    good = vis.filter(~F.col("flag")).withColumn("bin", F.floor((F.col("chan") - 1) / per_bin).cast("int"))
    w = F.sum("weight")
    return good.groupBy(*keys, "bin").agg((F.sum(F.col("weight") * F.col("re")) / w).alias("re"), (F.sum(F.col("weight") * F.col("im")) / w).alias("im"), w.alias("weight"), F.avg("freq").alias("freq"))


#: Samples that a task puts in order along their tracks, on average.
TRACKED = 1 << 18


def _track() -> WindowSpec:
    """Samples of a baseline and channel in the order of time."""
    return Window.partitionBy("ant1", "ant2", "chan").orderBy("time", "row_id")


def tracks(vis: DataFrame, *more: str) -> DataFrame:
    """Unflagged samples with ``moved``: wavelengths along the track of their baseline and channel since the sample before.

    The samples are counted first, and dealt out to as many tasks as hold ``TRACKED`` each.
    """
    good = vis.filter(~F.col("flag"))
    tasks = max(vis.sparkSession.sparkContext.defaultParallelism, -(-good.count() // TRACKED))
    dealt = good.select("ant1", "ant2", "chan", "time", "row_id", "u", "v", "w", "freq", *more).repartition(tasks, "ant1", "ant2", "chan")
    step = sum(((F.col(c) - F.lag(c).over(_track())) ** 2 for c in ("u", "v", "w")), F.lit(0.0))
    return dealt.withColumn("moved", F.coalesce(F.sqrt(step) * F.col("freq") / C, F.lit(0.0)))


def average_baselines(vis: DataFrame, decorrelation: float, field_rad: float) -> DataFrame:
    """Baseline-dependent time averaging.

    A bin of a baseline closes when its uvw track has moved so far that the
    phase at the edge of the field decorrelates by more than ``decorrelation``:
    sinc(pi x) = decorrelation at x turns.  Long baselines close bins sooner.
    """
    # smallest x > 0 with sinc(pi x) = decorrelation, by bisection
    lo, hi = 1e-9, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sin(pi * mid) / (pi * mid) > decorrelation else (lo, mid)
    limit = lo / (field_rad / 2)
    far = F.sum("moved").over(_track().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    path = tracks(vis, "re", "im", "weight").withColumn("bin", F.floor(far / limit).cast("long"))
    w = F.sum("weight")
    mean = [(F.sum(F.col("weight") * F.col(c)) / w).alias(c) for c in ("re", "im", "u", "v", "w", "time")]
    return path.groupBy("ant1", "ant2", "chan", "bin").agg(*mean, w.alias("weight"), F.count("*").alias("samples"))


def rephase(vis: DataFrame, l: float, m: float) -> DataFrame:
    """Moves the phase centre to direction cosines (l, m)."""
    re, im = cmul((F.col("re"), F.col("im")), phasor(uvw_phase(F.col("u"), F.col("v"), F.col("w"), F.col("freq"), l, m)))
    return vis.withColumns({"re": re, "im": im})


def rotation(axis: tuple[float, float, float], angle: float) -> list[list[float]]:
    """Rodrigues' rotation matrix about a unit axis."""
    x, y, z = axis
    s, c = sin(angle), cos(angle)
    k = [[0, -z, y], [z, 0, -x], [-y, x, 0]]
    square = [[sum(k[i][n] * k[n][j] for n in range(3)) for j in range(3)] for i in range(3)]
    return [[(i == j) + s * k[i][j] + (1 - c) * square[i][j] for j in range(3)] for i in range(3)]


def rotate_uvw(vis: DataFrame, matrix: list[list[float]]) -> DataFrame:
    cols = ("u", "v", "w")
    return vis.withColumns({c: sum((matrix[i][j] * F.col(cols[j]) for j in range(3)), F.lit(0.0)) for i, c in enumerate(cols)})


def sin_projection(ra: Column, dec: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Direction cosines (l, m) of a position about a phase centre, radians."""
    d = ra - ra0
    return F.cos(dec) * F.sin(d), F.sin(dec) * cos(dec0) - F.cos(dec) * sin(dec0) * F.cos(d)


def inject(vis: DataFrame, l: float, m: float, flux: Column) -> DataFrame:
    """Adds a point source: flux exp(-2 pi i f/c ...)."""
    re, im = phasor(-uvw_phase(F.col("u"), F.col("v"), F.col("w"), F.col("freq"), l, m))
    return vis.withColumn("re", F.col("re") + flux * re).withColumn("im", F.col("im") + flux * im)
