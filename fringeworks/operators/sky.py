"""Grids on the sky: orthographic (SIN) projection, images brought from one grid to another, and regions.

Angles are radians but where a name says degrees.  Pixel x of an image lies at
l = (x - middle) * cell, l growing with right ascension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_sky(l: Column, m: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """(ra, dec) of direction cosines about (ra0, dec0); null beyond the horizon."""
    rest = 1 - l * l - m * m
    n = F.sqrt(F.when(rest >= 0, rest))
    s = m * F.cos(dec0) + n * F.sin(dec0)
    return ra0 + F.atan2(l, n * F.cos(dec0) - m * F.sin(dec0)), F.when(s.isNotNull(), F.asin(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0))))


def from_sky(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """(l, m) about (ra0, dec0); null on the far side of the sky."""
    turn = ra - ra0
    near = F.sin(dec) * F.sin(dec0) + F.cos(dec) * F.cos(dec0) * F.cos(turn) >= 0
    l, m = F.cos(dec) * F.sin(turn), F.sin(dec) * F.cos(dec0) - F.cos(dec) * F.sin(dec0) * F.cos(turn)
    return F.when(near, l), F.when(near, m)


def reproject(images: DataFrame, fields: DataFrame, keys: list[str], nx: int, ny: int, cell: float, cell_in: float, middle_in: tuple[float, float], middle: tuple[float, float] | None = None) -> DataFrame:
    """Rows (keys, x, y, value, defined): the images on grids of nx x ny pixels about another centre, bilinearly.

    images: keys, x, y, value.  fields: keys, ra_in, dec_in, ra, dec, one row for
    each image and target.  A pixel is undefined, and its value 0, if a neighbour
    that has a share in it is missing, null or NaN, or if it lies beyond the horizon of
    either grid.  Pixels meet their neighbours by (keys, x, y) in one join: each asks
    only those that have a share, four at most.
    """
    cx, cy = middle or (nx // 2, ny // 2)
    grid = fields.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    ra, dec = to_sky((F.col("x") - cx) * cell, (F.col("y") - cy) * cell, F.col("ra"), F.col("dec"))
    l, m = from_sky(F.col("_ra"), F.col("_dec"), F.col("ra_in"), F.col("dec_in"))
    placed = grid.withColumn("_ra", ra).withColumn("_dec", dec).select(*keys, "x", "y", (l / cell_in + middle_in[0]).alias("_px"), (m / cell_in + middle_in[1]).alias("_py"))
    # places within a billionth of a pixel's centre are there, so that a grid on itself keeps its edge
    snapped = lambda c: F.when(F.abs(F.col(c) - F.round(c)) < 1e-9, F.round(c)).otherwise(F.col(c))
    placed = placed.withColumns({"_px": snapped("_px"), "_py": snapped("_py")}).withColumns({"_ix": F.floor("_px"), "_iy": F.floor("_py")})
    fx, fy = F.col("_px") - F.col("_ix"), F.col("_py") - F.col("_iy")
    near = [F.struct((F.col("_ix") + i).alias("ix"), (F.col("_iy") + j).alias("iy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("share")) for i in (0, 1) for j in (0, 1)]
    asked = placed.select(*keys, "x", "y", F.explode_outer(F.filter(F.array(*near), lambda n: n["share"] > 0)).alias("n")).select(*keys, "x", "y", "n.*")
    there = images.select(*keys, F.col("x").cast("long").alias("ix"), F.col("y").cast("long").alias("iy"), F.nanvl("value", F.lit(None).cast("double")).alias("_v")).filter("_v IS NOT NULL")
    met = asked.join(there, [*keys, "ix", "iy"], "left").groupBy(*keys, "x", "y")
    sums = met.agg(F.sum(F.col("share") * F.col("_v")).alias("value"), (F.count("_v") == F.count("*")).alias("defined"))
    return sums.withColumn("value", F.when(F.col("defined"), F.col("value")).otherwise(0.0))


def spans(polygons: DataFrame, nx: int, ny: int) -> DataFrame:
    """Rows (region, y, first, last): the runs of pixels whose centres lie in a polygon, by the even-odd rule.

    polygons: region, i, x, y; the vertices in the order of i, in pixels; a vertex
    with a null or NaN is left out.  An edge meets the rows between its ends, the lower one
    included; a row's crossings in order open and close its runs.  The work is that
    of edges times rows, not of pixels times edges; a polygon's rows are spread over tasks.
    """
    known = polygons.filter("region IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND x IS NOT NULL AND y IS NOT NULL")
    order = Window.partitionBy("region").orderBy("i")
    start = F.first(F.struct("x", "y")).over(order)
    edges = known.withColumn("to", F.coalesce(F.lead(F.struct("x", "y")).over(order), start)).withColumns({"x2": F.col("to.x"), "y2": F.col("to.y")})
    lower, upper = F.greatest(F.ceil(F.least("y", "y2")), F.lit(0)), F.least(F.ceil(F.greatest("y", "y2")) - 1, F.lit(ny - 1))
    rows = edges.withColumns({"lower": lower, "upper": upper}).filter("lower <= upper").withColumn("row", F.explode(F.sequence("lower", "upper")))
    crossing = (F.col("x2") - F.col("x")) * (F.col("row") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")
    crossings = rows.select("region", F.col("row").cast("int").alias("y"), crossing.alias("c"))
    across = Window.partitionBy("region", "y").orderBy("c")
    opened = crossings.withColumns({"place": F.row_number().over(across), "end": F.lead("c").over(across)}).filter("place % 2 = 1")
    first, last = F.greatest(F.ceil("c"), F.lit(0)), F.least(F.ceil("end") - 1, F.lit(nx - 1))
    return opened.select("region", "y", first.cast("int").alias("first"), last.cast("int").alias("last")).filter("first <= last")


def circle_spans(circles: DataFrame, nx: int, ny: int) -> DataFrame:
    """The same for circles (region, x, y, radius): pixels nearer to the centre than the radius."""
    lower, upper = F.greatest(F.ceil(F.col("y") - F.col("radius")), F.lit(0)), F.least(F.floor(F.col("y") + F.col("radius")), F.lit(ny - 1))
    rows = circles.filter("radius > 0").withColumns({"lower": lower, "upper": upper}).filter("lower <= upper").withColumn("row", F.explode(F.sequence("lower", "upper")))
    half = F.sqrt(F.greatest(F.col("radius") ** 2 - (F.col("row") - F.col("y")) ** 2, F.lit(0.0)))
    # centres on the circle are outside
    first, last = F.greatest(F.floor(F.col("x") - half) + 1, F.lit(0)), F.least(F.ceil(F.col("x") + half) - 1, F.lit(nx - 1))
    return rows.select("region", F.col("row").cast("int").alias("y"), first.cast("int").alias("first"), last.cast("int").alias("last")).filter("first <= last")


def masks(runs: DataFrame) -> DataFrame:
    """Rows (region, x, y), one for each pixel of a region."""
    return runs.select("region", F.explode(F.sequence("first", "last")).alias("x"), "y").distinct()


def overlaps(mask: DataFrame) -> DataFrame:
    """Rows (x, y, regions): pixels of more than one region."""
    return mask.groupBy("x", "y").agg(F.array_sort(F.collect_set("region")).alias("regions")).filter(F.size("regions") > 1)


def split(images: DataFrame, mask: DataFrame) -> DataFrame:
    """The images' pixels with their region, null in the remainder; an error if regions overlap."""
    both = overlaps(mask).first()
    if both:
        raise ValueError(f"regions {both['regions']} overlap in pixel ({both['x']}, {both['y']})")
    return images.join(mask, ["x", "y"], "left")


def to_pixels(points: DataFrame, ra0_deg: float, dec0_deg: float, nx: int, ny: int, cell: float) -> DataFrame:
    """Points (ra_deg, dec_deg, ...) as pixels x, y of an image; null on the far side of the sky."""
    l, m = from_sky(F.radians("ra_deg"), F.radians("dec_deg"), F.radians(F.lit(ra0_deg)), F.radians(F.lit(dec0_deg)))
    return points.withColumns({"x": l / cell + nx // 2, "y": m / cell + ny // 2}).drop("ra_deg", "dec_deg")
