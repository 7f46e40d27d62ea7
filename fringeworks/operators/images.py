"""Algebra of image tables (keys..., x, y, value): proxes, masks, wavelets, fits, high-cadence products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(image: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation and largest absolute value."""
    return image.groupBy(*keys).agg(F.stddev_pop("value").alias("rms"), F.max(F.abs("value")).alias("rmax"))


def soft(value: Column, step: Column | float) -> Column:
    return F.signum(value) * F.greatest(F.abs(value) - step, F.lit(0.0))


def prox_l21(cube: DataFrame, keys: list[str], step: float, form: str = "sum") -> DataFrame:
    """Group threshold over the bands of a coefficient; ``sum``: |sum over bands|, ``norm``: the 2-norm."""
    w = Window.partitionBy(*keys)
    size = F.abs(F.sum("value").over(w)) if form == "sum" else F.sqrt(F.sum(F.col("value") * F.col("value")).over(w))
    return cube.withColumn("size", size).withColumn("value", F.when(F.col("size") > 0, F.col("value") * F.greatest(F.col("size") - step, F.lit(0.0)) / F.col("size")).otherwise(0.0)).drop("size")


def dual_update(cube: DataFrame, keys: list[str], bound: float) -> DataFrame:
    """v * min(1, bound / |sum over bands|)."""
    total = F.abs(F.sum("value").over(Window.partitionBy(*keys)))
    return cube.withColumn("value", F.col("value") * F.coalesce(F.least(F.lit(1.0), bound / F.nullif(total, F.lit(0.0))), F.lit(1.0)))


def positive(cube: DataFrame, keys: list[str], mode: int) -> DataFrame:
    """1: negative values to 0; 2: all bands of a pixel to 0 where any is not above 0; 0: nothing."""
    if mode == 1:
        return cube.withColumn("value", F.greatest("value", F.lit(0.0)))
    if mode == 2:
        return cube.withColumn("value", F.when(F.min("value").over(Window.partitionBy(*keys)) <= 0, 0.0).otherwise(F.col("value")))
    return cube


def reweighted(cube: DataFrame, keys: list[str], basis: list[str], factor: float, power: float) -> DataFrame:
    """(1 + k) / (1 + |s|^a / rms^a), s the sum over bands, rms the deviation of a basis' non-zero sums."""
    sums = cube.groupBy(*basis, *keys).agg(F.sum("value").alias("s"))
    rms = F.coalesce(F.stddev_pop(F.when(F.col("s") != 0, F.col("s"))).over(Window.partitionBy(*basis)), F.lit(1.0))
    return sums.withColumn("weight", (1 + factor) / (1 + F.pow(F.abs("s"), F.lit(power)) / F.pow(rms, F.lit(power))))


def masked(image: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels outside the mask become 0.  mask: x, y."""
    return image.join(mask.select("x", "y", F.lit(True).alias("inside")), ["x", "y"], "left").withColumn("value", F.when(F.col("inside"), F.col("value")).otherwise(0.0)).drop("inside")


_CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def _neighbours(mask: DataFrame) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _CROSS))
    return mask.select("x", "y", F.explode(steps).alias("s")).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))


def dilated(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    return _neighbours(mask).filter(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1)).distinct()


def eroded(mask: DataFrame) -> DataFrame:
    """Pixels whose four neighbours are all in the mask; beyond the border counts as outside."""
    return _neighbours(mask.select("x", "y").distinct()).groupBy("x", "y").count().filter(F.col("count") == len(_CROSS)).select("x", "y")


def islands(mask: DataFrame) -> DataFrame:
    """Connected components of pixels: (x, y, island), named by the least x * 2^20 + y; labels spread until none changes.

    A label is a pixel of the island, so labels also jump to their own pixel's
    label: a round reaches about twice as far as the one before.
    """
    from ..plans.tables import stored

    name = (F.col("x").cast("long") * (1 << 20) + F.col("y")).alias("island")
    label = stored(mask.select("x", "y", name).distinct(), "islands")
    while True:
        near = label.crossJoin(F.broadcast(label.sparkSession.createDataFrame(_CROSS, "dx int, dy int"))).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "island")
        least = near.groupBy("x", "y").agg(F.min("island").alias("least"))
        step = label.join(least, ["x", "y"])
        jump = step.select(name.alias("least"), F.col("least").alias("further"))
        moved = stored(step.join(jump, "least").select("x", "y", F.col("further").alias("next"), (F.col("further") < F.col("island")).alias("moved")), "islands")
        label = moved.select("x", "y", F.col("next").alias("island"))
        if not moved.filter("moved").take(1):
            break
    return label


def haar(image: DataFrame, keys: list[str]) -> DataFrame:
    """One level of the Haar transform on even images: coefficients (kind, i, j, value), kind of LL, LH, HL, HH."""
    even = lambda c: F.col(c) % 2 == 0
    sign = {"LL": F.lit(1.0), "LH": F.when(even("y"), 1.0).otherwise(-1.0), "HL": F.when(even("x"), 1.0).otherwise(-1.0), "HH": F.when(even("x") == even("y"), 1.0).otherwise(-1.0)}
    sums = [F.struct(F.lit(k).alias("kind"), F.sum(s * F.col("value") / 2).alias("value")) for k, s in sign.items()]
    return image.groupBy(*keys, F.floor(F.col("x") / 2).cast("int").alias("i"), F.floor(F.col("y") / 2).cast("int").alias("j")).agg(F.array(*sums).alias("c")).select(*keys, "i", "j", F.explode("c").alias("c")).select(*keys, "c.kind", "i", "j", "c.value")


def inverse_haar(coefficients: DataFrame, keys: list[str]) -> DataFrame:
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    e = coefficients.withColumn("p", F.explode(corners))
    a, b = F.col("p.a") == 0, F.col("p.b") == 0
    s = F.when(F.col("kind") == "LL", 1.0).when(F.col("kind") == "LH", F.when(b, 1.0).otherwise(-1.0)).when(F.col("kind") == "HL", F.when(a, 1.0).otherwise(-1.0)).otherwise(F.when(a == b, 1.0).otherwise(-1.0))
    return e.groupBy(*keys, (2 * F.col("i") + F.col("p.a")).cast("int").alias("x"), (2 * F.col("j") + F.col("p.b")).cast("int").alias("y")).agg(F.sum(s * F.col("value") / 2).alias("value"))


def design(freqs: list[float], order: int, basis: str = "legendre", ref: float | None = None) -> np.ndarray:
    """(freqs, order) columns of a spectral basis; the constant is the first of ``order``."""
    f = np.array(freqs, float)
    if basis == "legendre":
        mid = (f.max() + f.min()) / 2
        x = (f - mid) / max(np.abs(f - mid).max(), 1e-30)
        return np.polynomial.legendre.legvander(x, order - 1)
    return np.vander(f / (ref or f[0]), order, increasing=True)


def solver(x: np.ndarray, weights: list[float], ridge: float = 0.0) -> np.ndarray:
    """(X^T W X + ridge I)^-1 X^T W: the same small matrix for every pixel."""
    w = np.array(weights, float)
    return np.linalg.solve(x.T @ (w[:, None] * x) + ridge * np.eye(x.shape[1]), x.T * w)


def fit_components(cube: DataFrame, keys: list[str], band: str, matrix: np.ndarray) -> DataFrame:
    """Coefficients c0, c1, ... of each pixel: sums of its bands' values times a literal matrix."""
    at = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in matrix))
    return cube.groupBy(*keys).agg(*(F.sum(F.col("value") * F.get(F.get(at, F.lit(k)), F.col(band).cast("int"))).alias(f"c{k}") for k in range(matrix.shape[0])))


def evaluate_components(fitted: DataFrame, keys: list[str], x: np.ndarray, band: str = "band") -> DataFrame:
    """Values of each pixel at the frequencies of a design matrix."""
    rows = F.array(*(F.struct(F.lit(i).alias(band), sum((float(v) * F.col(f"c{k}") for k, v in enumerate(r)), F.lit(0.0)).alias("value")) for i, r in enumerate(x)))
    return fitted.select(*keys, F.explode(rows).alias("r")).select(*keys, f"r.{band}", "r.value")


def extrapolated(cube: DataFrame, keys: list[str], freqs: tuple[float, float], out: float) -> DataFrame:
    """Straight line through bands 0 and 1, at another frequency."""
    value = lambda b: F.sum(F.when(F.col("band") == b, F.col("value")).otherwise(0.0))
    t = (out - freqs[0]) / (freqs[1] - freqs[0])
    return cube.filter("band < 2").groupBy(*keys).agg((value(0) * (1 - t) + value(1) * t).alias("value"))


def resampled(image: DataFrame, keys: list[str], factor: float, nx: int, ny: int) -> DataFrame:
    """Bilinear resampling onto pixels of ``factor`` times the size, 0 outside, times the ratio of areas.

    Each input pixel goes to the output pixels it takes part in, so no grid is joined.
    """
    axis = lambda c, n: F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.greatest(1 - F.abs(i * factor - F.col(c)), F.lit(0.0)).alias("w"))), lambda s: s["w"] > 0)
    spread = image.withColumn("a", F.explode(axis("x", nx))).withColumn("b", F.explode(axis("y", ny)))
    return spread.groupBy(*keys, F.col("a.i").alias("x"), F.col("b.i").alias("y")).agg((F.sum(F.col("value") * F.col("a.w") * F.col("b.w")) * factor * factor).alias("value"))


def spectral_index(table: DataFrame, keys: list[str]) -> DataFrame:
    """Slope of log flux against log frequency."""
    good = table.filter("flux > 0")
    return good.groupBy(*keys).agg(F.regr_slope(F.ln("flux"), F.ln("freq")).alias("index"), F.exp(F.regr_intercept(F.ln("flux"), F.ln("freq"))).alias("amplitude"))


def moments(image: DataFrame, keys: list[str]) -> DataFrame:
    """Flux-weighted second moments about the centroid."""
    s, v = F.sum("value"), F.col("value")
    mean = lambda c: F.sum(v * F.col(c)) / s
    second = lambda a, b: F.sum(v * F.col(a) * F.col(b)) / s - mean(a) * mean(b)
    return image.groupBy(*keys).agg(mean("x").alias("mx"), mean("y").alias("my"), second("x", "x").alias("mxx"), second("x", "y").alias("mxy"), second("y", "y").alias("myy"))


def flag_by_rms(blocks: DataFrame, keys: list[str], k: float) -> DataFrame:
    """flag: rms above k times the median of the non-zero ones over time, or 0."""
    median = blocks.filter("rms <> 0").groupBy(*keys).agg(F.percentile("rms", 0.5).alias("median"))
    return blocks.join(median, keys, "left").withColumn("flag", (F.col("rms") == 0) | F.coalesce(F.col("rms") > k * F.col("median"), F.lit(True))).drop("median")


def weighted_mean(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted time mean of what is not flagged."""
    good = blocks.filter(~F.col("flag"))
    return good.groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("value"), F.sum("weight").alias("wsum"))


def interpolated(rows: DataFrame, knots: DataFrame, at: str, x: str = "x", y: str = "y") -> DataFrame:
    """Linear interpolation between the knots on both sides of each row, clamped at the ends.

    Knots are a small profile; brackets come from unioning both and looking
    back and ahead, so nothing is compared pair by pair.
    """
    last = knots.orderBy(x).select(F.struct(x, y)).collect()  # a profile's knots
    profile = F.array(*(F.struct(F.lit(float(r[0][0])).alias("x"), F.lit(float(r[0][1])).alias("y")) for r in last))
    after = F.array_position(F.transform(profile, lambda p: p["x"] > F.col(at)), F.lit(True))
    hi = F.when(after == 0, F.lit(len(last))).otherwise(after)
    lo = F.greatest(hi - 1, F.lit(1))
    p, q = F.element_at(profile, lo.cast("int")), F.element_at(profile, hi.cast("int"))
    inner = p["y"] + (q["y"] - p["y"]) * (F.col(at) - p["x"]) / F.nullif(q["x"] - p["x"], F.lit(0.0))
    value = F.when(after == 0, F.lit(float(last[-1][0][1]))).when(after == 1, F.lit(float(last[0][0][1]))).otherwise(inner)
    return rows.withColumn("value", value)


def along_axis(cube: DataFrame, axis: str, matrix: np.ndarray, keys: list[str]) -> DataFrame:
    """Product of a small matrix with one axis of a cube; applied to each axis in turn it is a Kronecker product."""
    columns = F.array(*(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("k")) for i, v in enumerate(col) if v)) for col in matrix.T))
    spread = cube.withColumn("t", F.explode(F.get(columns, F.col(axis))))
    return spread.groupBy(*keys, F.col("t.i").cast("int").alias(axis)).agg(F.sum(F.col("value") * F.col("t.k")).alias("value"))
