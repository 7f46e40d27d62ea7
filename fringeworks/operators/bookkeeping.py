"""Checks, dimension joins, names and weighted means of measurement tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite_uvw(vis: DataFrame) -> DataFrame:
    """Samples whose uvw is neither NaN nor null: regular grids are padded with NaN."""
    return vis.filter(~(F.isnan("u") | F.isnan("v") | F.isnan("w")))


def missing_antennas(vis: DataFrame, antennas: DataFrame) -> DataFrame:
    """Antennas of the visibilities that the antenna table lacks, with their samples; empty if they agree."""
    used = vis.select(F.explode(F.array("ant1", "ant2")).alias("ant")).groupBy("ant").agg(F.count("*").alias("samples"))
    return used.join(antennas.select("ant").distinct(), "ant", "left_anti")


def with_frames(vis: DataFrame, windows: DataFrame, fields: DataFrame) -> DataFrame:
    """Each sample's spectral window (ddid, ...) and phase centre (field_id, ...); samples without one are kept, with nulls."""
    return vis.join(windows, "ddid", "left").join(fields, "field_id", "left")


def antenna_numbers(antennas: DataFrame, name: str = "name") -> DataFrame:
    """(name, index): antennas by name, numbered from 0 in order.  One row for each antenna."""
    return antennas.select(name).distinct().withColumn("index", (F.row_number().over(Window.orderBy(name)) - 1).cast("int"))


def by_number(vis: DataFrame, antennas: DataFrame, columns: list[str], name: str = "name") -> DataFrame:
    """Antenna names in ``columns`` replaced by their numbers; an unknown name becomes null."""
    numbers = antenna_numbers(antennas, name)
    for c in columns:
        vis = vis.join(numbers.select(F.col(name).alias(c), F.col("index").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return vis


def relabelled(vis: DataFrame, numbers: DataFrame) -> DataFrame:
    """ant1 and ant2 by the dense numbers (ant, index) of the antennas in use."""
    for c in ("ant1", "ant2"):
        vis = vis.join(numbers.select(F.col("ant").alias(c), F.col("index").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return vis


def descents(table: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Rows of each group, and those at which ``column`` falls below the row before: 0 if it never descends."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    return table.select(*keys, (F.col(column) < before).alias("falls")).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("falls").alias("falls"))


def spectra(pieces: DataFrame, keys: list[str], piece: list[str]) -> DataFrame:
    """Groups of pieces that are to be joined end to end: pieces, samples and whether all have the same channels."""
    each = pieces.groupBy(*keys, *piece).agg(F.array_sort(F.collect_set("freq")).alias("freqs"), F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.count("*").alias("pieces"), F.sum("n").alias("samples"), (F.countDistinct("freqs") == 1).alias("aligned"))


def part_ids(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The distinct (keys, order), numbered from 0 by ``order`` within their keys."""
    return table.select(*keys, *order).distinct().withColumn("part", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def weighted_mean(table: DataFrame, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """(keys, value, weight): mean of ``value`` by ``weight``, and the weights' sum; null where that is 0."""
    w = F.sum(weight)
    return table.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(w, F.lit(0.0))).alias(value), w.alias(weight))


def with_weight(bands: DataFrame, wsum: str = "wsum") -> DataFrame:
    """Bands that have any weight."""
    return bands.filter(F.col(wsum) > 0)


def any_of(masks: list[DataFrame]) -> DataFrame:
    """(x, y, mask): set where any of the masks is; pixels that a mask lacks are unset in it."""
    all_of = masks[0].select("x", "y", "mask")
    for m in masks[1:]:
        all_of = all_of.unionByName(m.select("x", "y", "mask"))
    return all_of.groupBy("x", "y").agg(F.coalesce(F.bool_or("mask"), F.lit(False)).alias("mask"))


def _spread(table: DataFrame, keys: list[str], columns: tuple[str, str, str]) -> DataFrame:
    """The covariance a b c / b d e / c e f of three columns, their means, and its least and largest eigenvalue.

    The eigenvalues are q + 2 p cos of three angles, the roots of the characteristic cubic.
    """
    x, y, z = columns
    pairs = {"a": (x, x), "b": (x, y), "c": (x, z), "d": (y, y), "e": (y, z), "f": (z, z)}
    t = table.groupBy(*keys).agg(*(F.covar_samp(*p).alias(k) for k, p in pairs.items()), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)))
    a, b, c, d, e, f = map(F.col, "abcdef")
    t = t.withColumn("q", (a + d + f) / 3)
    q = F.col("q")
    t = t.withColumn("p", F.sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)) / 6))
    size = (a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - c * e) + c * (b * e - c * (d - q))
    p = F.col("p")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), size / (2 * p * p * p)))) / 3
    return t.withColumn("angle", angle).withColumns({"least": q + 2 * p * F.cos(F.col("angle") + 2 * pi / 3), "largest": q + 2 * p * F.cos("angle")})


def planar(vis: DataFrame, keys: list[str], threshold: float = 1e-5) -> DataFrame:
    """(keys, ratio, planar): least over largest eigenvalue of the uvw covariance, and whether the samples lie in a plane by it."""
    s = _spread(vis, keys, ("u", "v", "w"))
    return s.select(*keys, (F.col("least") / F.col("largest")).alias("ratio")).withColumn("planar", F.col("ratio") <= threshold)


def hyperplane(table: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """(keys, t0, t1, t2): z = t0 x + t1 y + t2 by total least squares, the normal being the least eigenvector."""
    a, b, c, d, e, least = map(F.col, ("a", "b", "c", "d", "e", "least"))
    s = _spread(table, keys, (x, y, z))
    # the normal is across the first two rows of the covariance less the eigenvalue
    n = (b * e - c * (d - least), c * b - (a - least) * e, (a - least) * (d - least) - b * b)
    s = s.withColumns({"n0": n[0], "n1": n[1], "n2": F.nullif(n[2], F.lit(0.0))})
    t0, t1 = -F.col("n0") / F.col("n2"), -F.col("n1") / F.col("n2")
    return s.select(*keys, t0.alias("t0"), t1.alias("t1"), (F.col("m2") - t0 * F.col("m0") - t1 * F.col("m1")).alias("t2"))


def partition_name(field: Column, ddid: Column, scan: Column) -> Column:
    return F.format_string("FIELD%d_DDID%d_SCAN%d", field, ddid, scan)


def partition_of(name: Column) -> list[Column]:
    """field_id, ddid and scan of a partition's name."""
    return [F.regexp_extract(name, rf"{k}(\d+)", 1).cast("int").alias(c) for k, c in (("FIELD", "field_id"), ("DDID", "ddid"), ("SCAN", "scan"))]


def image_name(band: Column, time: Column) -> Column:
    return F.format_string("band%04d_time%04d", band, time)


def noise(vis: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Normal noise (n_re, n_im) of variance 1 / weight in each part, 0 without weight.

    It depends on the key and the seed alone, so a task that runs again gives the
    same noise, however the table is cut.
    """
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed), F.lit(k)), 11).cast("double") + 1) / float(2**53 + 1)
    size = F.sqrt(-2 * F.ln(uniform(0))) * F.when(F.col("weight") > 0, 1 / F.sqrt("weight")).otherwise(0.0)
    turn = 2 * pi * uniform(1)
    return vis.withColumns({"n_re": size * F.cos(turn), "n_im": size * F.sin(turn)})


def bilinear(points: DataFrame, beam: DataFrame, keys: list[str], point: list[str], nx: int, ny: int, outside: float = 1.0) -> DataFrame:
    """A pattern at fractional pixels: (keys, point, value), ``outside`` where a point is off the grid.

    points: keys, point columns, px, py in the pattern's pixels; beam: keys, x, y, value.
    Each point meets its four neighbours by a join on their indices.
    """
    inside = (F.col("px") >= 0) & (F.col("px") <= nx - 1) & (F.col("py") >= 0) & (F.col("py") <= ny - 1)
    i, j = F.least(F.floor("px"), F.lit(nx - 2)).cast("int"), F.least(F.floor("py"), F.lit(ny - 2)).cast("int")
    corner = lambda a, b: F.struct((i + a).alias("x"), (j + b).alias("y"), ((1 - F.abs(F.col("px") - i - a)) * (1 - F.abs(F.col("py") - j - b))).alias("share"))
    near = points.withColumn("n", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))))
    near = near.select(*keys, *point, inside.alias("inside"), "n.x", "n.y", "n.share")
    met = near.join(beam.select(*keys, "x", "y", "value"), [*keys, "x", "y"], "left")
    return met.groupBy(*keys, *point).agg(F.when(F.first("inside"), F.sum(F.col("share") * F.col("value"))).otherwise(outside).alias("value"))
