"""Primary beams: an analytic one, planes between given frequencies, and images corrected by them."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the cosine-tapered field: its scale, and the width at half power (degrees) at 1 GHz, 57.5' at 1.5 GHz.
SCALE, WIDTH_AT_1GHZ = 1.189, 57.5 / 60 * 1.5


def cosine_beam(l: Column, m: Column, freq: Column, width_at_1ghz: float = WIDTH_AT_1GHZ) -> Column:
    """Power of a cosine-tapered aperture at (l, m) in degrees and ``freq`` in Hz; 1 at the centre."""
    r = SCALE * F.sqrt(l * l + m * m) * freq / (1e9 * width_at_1ghz)
    edge = 1 - 4 * r * r
    # both parts vanish at r = 1/2, where their ratio is pi / 4
    field = F.when(F.abs(edge) < 1e-9, pi / 4).otherwise(F.cos(pi * r) / edge)
    return field * field


def at_frequencies(beam: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, x, y, value) of the beam between its planes at each target's ``freq``, linearly.

    beam: freq, x, y, value; targets: keys, freq.  Frequencies outside the planes,
    and null ones, give no rows.  The planes' frequencies are one row that goes to
    all tasks; pixels meet by equal frequencies.
    """
    knots = beam.filter("freq IS NOT NULL").agg(F.collect_set("freq").alias("knots"))
    near = targets.select(*keys, "freq").crossJoin(F.broadcast(knots))  # one row
    lo = F.array_max(F.filter("knots", lambda k: k <= F.col("freq")))
    hi = F.array_min(F.filter("knots", lambda k: k >= F.col("freq")))
    spans = near.select(*keys, F.col("freq").alias("_f"), lo.alias("_lo"), hi.alias("_hi")).filter("_lo IS NOT NULL AND _hi IS NOT NULL")
    plane = lambda at, value: beam.select(F.col("freq").alias(at), "x", "y", F.col("value").alias(value))
    both = spans.join(plane("_lo", "_a"), "_lo").join(plane("_hi", "_b"), ["_hi", "x", "y"])
    share = F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise((F.col("_f") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return both.select(*keys, "x", "y", (F.col("_a") + share * (F.col("_b") - F.col("_a"))).alias("value"))


def divided(images: DataFrame, beam: DataFrame, keys: list[str], eta: float) -> DataFrame:
    """value * b / (b^2 + eta): the step of a gradient in the metric of the beam.

    beam: keys, beam.  Pixels without a beam are left as they are, as if it were 1 and ``eta`` 0.
    """
    b = F.col("beam")
    step = F.col("value") * b / F.nullif(b * b + eta, F.lit(0.0))
    joined = images.join(beam.select(*keys, "beam"), keys, "left")
    return joined.withColumn("value", F.when(b.isNull(), F.col("value")).otherwise(F.coalesce(step, F.lit(0.0)))).drop("beam")


def summary(vis: DataFrame, keys: list[str]) -> DataFrame:
    """What a plan needs to know of each partition: its ranges of time and frequency, its sizes and its antennas."""
    antennas = F.array_sort(F.array_union(F.collect_set("ant1"), F.collect_set("ant2")))
    return vis.groupBy(*keys).agg(
        F.min("time").alias("first"), F.max("time").alias("last"), F.min("freq").alias("lowest"), F.max("freq").alias("highest"),
        F.count("*").alias("samples"), F.sum(F.col("flag").cast("long")).alias("flagged"), F.size(antennas).alias("n_ant"), F.array_join(antennas, ",").alias("antennas"),
    )
