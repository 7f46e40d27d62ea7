"""Wavelet transforms of image tables on several levels, as sums over filter taps.

A pixel reaches few coefficients: each row is spread to those and they are summed,
so a transform is one aggregation for each axis and level, and no image has to fit
in a task.  Borders are padded with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .solvers import DAUBECHIES


def filters(name: str) -> tuple[list[float], list[float]]:
    """Scaling and wavelet filter of synthesis; analysis uses them reversed."""
    low = DAUBECHIES[name]
    return low, [(-1) ** k * v for k, v in enumerate(reversed(low))]


def coefficient_size(n: int, taps: int) -> int:
    return (n + taps - 1) // 2


def _taps(name: str) -> Column:
    """(k, low, high) of each tap of analysis."""
    low, high = (list(reversed(f)) for f in filters(name))
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b) in enumerate(zip(low, high, strict=True))))


def _split(table: DataFrame, keys: list[str], axis: str, name: str, n: int) -> DataFrame:
    """Rows of half the length along ``axis``: coefficient i is the sum over k of tap k times value 2 i + 1 - k."""
    size = coefficient_size(n, len(DAUBECHIES[name]))
    at = (F.col(axis) + F.col("t.k") - 1) / 2
    spread = table.withColumn("t", F.explode(F.filter(_taps(name), lambda t: (F.col(axis) + t["k"] - 1) % 2 == 0)))
    sums = spread.groupBy(*keys, at.cast("int").alias("at")).agg(F.sum(F.col("value") * F.col("t.low")).alias("L"), F.sum(F.col("value") * F.col("t.high")).alias("H"))
    both = F.explode(F.array(*(F.struct(F.lit(b).alias("band_of"), F.col(b).alias("value")) for b in "LH")))
    return sums.filter((F.col("at") >= 0) & (F.col("at") < size)).select(*keys, F.col("at").alias(axis), both.alias("s")).select(*keys, axis, "s.band_of", "s.value")


def _merge(table: DataFrame, keys: list[str], axis: str, name: str, n: int) -> DataFrame:
    """The inverse of ``_split`` on a table (keys, axis, band_of, value), cut to n rows."""
    low, high = filters(name)
    back = len(low) - 2
    taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("L"), F.lit(b).alias("H")) for k, (a, b) in enumerate(zip(low, high, strict=True))))
    spread = table.withColumn("t", F.explode(taps))
    at = (2 * F.col(axis) + F.col("t.k") - back).cast("int")
    v = F.col("value") * F.when(F.col("band_of") == "L", F.col("t.L")).otherwise(F.col("t.H"))
    return spread.withColumn("at", at).filter((F.col("at") >= 0) & (F.col("at") < n)).groupBy(*keys, F.col("at").alias(axis)).agg(F.sum(v).alias("value"))


def sizes(nx: int, ny: int, name: str, levels: int) -> list[tuple[int, int]]:
    """Sizes of the image and of each level's coefficients."""
    out = [(nx, ny)]
    for _ in range(levels):
        out.append(tuple(coefficient_size(n, len(DAUBECHIES[name])) for n in out[-1]))
    return out


def analysis(image: DataFrame, keys: list[str], name: str, levels: int, nx: int, ny: int) -> DataFrame:
    """(keys, level, kind, x, y, value): HL, LH and HH of every level and LL of the last; kind names x, then y.

    image: keys, x, y, value; absent pixels are 0.
    """
    out, rest = [], image.select(*keys, "x", "y", "value")
    for level, (n, m) in enumerate(sizes(nx, ny, name, levels)[:-1], 1):
        across = _split(rest, [*keys, "y"], "x", name, n).withColumnRenamed("band_of", "of_x")
        done = _split(across, [*keys, "x", "of_x"], "y", name, m)
        named = done.select(*keys, F.lit(level).alias("level"), F.concat("of_x", "band_of").alias("kind"), "x", "y", "value")
        out.append(named if level == levels else named.filter("kind <> 'LL'"))
        rest = named.filter("kind = 'LL'").select(*keys, "x", "y", "value")
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table


def synthesis(coefficients: DataFrame, keys: list[str], name: str, levels: int, nx: int, ny: int) -> DataFrame:
    """The image of ``analysis``'s table; coefficients that are absent are 0."""
    shape, low = sizes(nx, ny, name, levels), None
    for level in range(levels, 0, -1):
        n, m = shape[level - 1]
        mine = coefficients.filter(F.col("level") == level).select(*keys, "kind", "x", "y", "value")
        if low is not None:
            mine = mine.unionByName(low.select(*keys, F.lit("LL").alias("kind"), "x", "y", "value"))
        halves = mine.select(*keys, F.substring("kind", 1, 1).alias("of_x"), F.substring("kind", 2, 1).alias("band_of"), "x", "y", "value")
        columns = _merge(halves, [*keys, "x", "of_x"], "y", name, m).withColumnRenamed("of_x", "band_of")
        low = _merge(columns, [*keys, "y"], "x", name, n)
    return low.select(*keys, "x", "y", "value")
