"""Queries on beams brought to other centres, and on regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sky
from ..sources import read
from .image_queries import BANDS, BXY, bands_of
from .registry import query, rounded

#: Cells of the given and the target grid, and the target's pixels.
CELL_IN, CELL, NX, NY = 0.02, 0.013, 12, 10
_CENTRES = {"ra_in": "0.1e0 + 0.3e0 * band", "dec_in": "-0.5e0 + 0.05e0 * band", "ra": "0.12e0 + 0.3e0 * band", "dec": "-0.51e0 + 0.05e0 * band"}


@query(f"""{BANDS}, fields AS (SELECT DISTINCT band, {", ".join(f"{e} AS {c}" for c, e in _CENTRES.items())} FROM bands),
    grid AS (SELECT *, (x - 6) * {CELL!r}e0 AS l, (y - 5) * {CELL!r}e0 AS m FROM fields, range({NX}) a(x), range({NY}) b(y)),
    deep AS (SELECT *, sqrt(1 - l * l - m * m) AS n FROM grid),
    sky AS (SELECT *, ra + atan2(l, n * cos(dec) - m * sin(dec)) - ra_in AS turn, asin(m * cos(dec) + n * sin(dec)) AS d FROM deep),
    placed AS (SELECT band, x, y, cos(d) * sin(turn) / {CELL_IN!r}e0 + 4 AS px, (sin(d) * cos(dec_in) - cos(d) * sin(dec_in) * cos(turn)) / {CELL_IN!r}e0 + 4 AS py FROM sky),
    near AS (SELECT p.band, p.x, p.y, sum((1 - abs(px - b.x)) * (1 - abs(py - b.y)) * value) AS value, count(*) AS n FROM placed p JOIN bands b ON p.band = b.band AND abs(px - b.x) < 1 AND abs(py - b.y) < 1 GROUP BY ALL)
    SELECT band, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(CASE WHEN n = 4 THEN value ELSE 0 END, 6) + 0 AS value, coalesce(n = 4, FALSE) AS defined FROM placed LEFT JOIN near USING (band, x, y)""")
def beam_reprojected(spark, sf_dir):
    """The bands' images, as beams of one pointing, on a finer grid about another; what they do not cover is 0."""
    bands = bands_of(spark, sf_dir)
    fields = bands.select("band").distinct().select("band", *(F.expr(e.replace("e0", "D")).alias(c) for c, e in _CENTRES.items()))
    return rounded(sky.reproject(bands, fields, ["band"], NX, NY, CELL, CELL_IN, (4, 4)), *BXY, "defined")


#: The corners of a region that is not convex, times its size; five of them, in order.
_CORNERS = [(4, 0), (1, 1), (-2, 4), (-1, -1), (0, -4)]
_CENTRE = ("(c_custkey % 61) + 0.37e0", "(c_custkey * 7 % 53) + 0.21e0", "0.2e0 + (c_custkey % 5) * 0.31e0")
_VERTICES = "vertices AS (SELECT c_custkey AS region, i, cx + size * ox AS x, cy + size * oy AS y FROM (SELECT c_custkey, {} AS cx, {} AS cy, {} AS size FROM customer), (VALUES {}) c(i, ox, oy))".format(*_CENTRE, ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(_CORNERS)))
_INSIDE = "sum(CASE WHEN (a.y > py) <> (b.y > py) AND px < (b.x - a.x) * (py - a.y) / (b.y - a.y) + a.x THEN 1 ELSE 0 END) % 2 = 1"


@query(f"""WITH {_VERTICES}, inside AS (SELECT a.region, px, py FROM vertices a JOIN vertices b ON a.region = b.region AND b.i = (a.i + 1) % 5, range(64) u(px), range(64) v(py) GROUP BY ALL HAVING {_INSIDE})
    SELECT CAST(px AS INT) AS x, CAST(py AS INT) AS y, count(*) AS regions, min(region) AS first, CAST(sum(region) AS BIGINT) AS total FROM inside GROUP BY px, py""")
def region_masks(spark, sf_dir):
    """A region of five corners for each customer on 64 x 64 pixels: how many, and which, lie over a pixel."""
    c = read(spark, sf_dir, "customer")
    cx, cy, size = (F.expr(e.replace("e0", "D")) for e in _CENTRE)
    corners = F.posexplode(F.array(*(F.struct(F.lit(x).alias("ox"), F.lit(y).alias("oy")) for x, y in _CORNERS))).alias("i", "o")
    vertices = c.select(F.col("c_custkey").alias("region"), cx.alias("cx"), cy.alias("cy"), size.alias("size"), corners)
    polygons = vertices.select("region", "i", (F.col("cx") + F.col("size") * F.col("o.ox")).alias("x"), (F.col("cy") + F.col("size") * F.col("o.oy")).alias("y"))
    return sky.masks(sky.spans(polygons, 64, 64)).groupBy("x", "y").agg(F.count("*").alias("regions"), F.min("region").alias("first"), F.sum("region").alias("total"))


@query(f"""{BANDS}, kept AS (SELECT band, value, CASE WHEN (x - c) * (x - c) + (y - 3.5e0) * (y - 3.5e0) < 0.64e0 * (1 + r_regionkey % 2) THEN r_regionkey END AS region, x, y
        FROM bands, (SELECT r_regionkey, 0.3e0 + 1.8e0 * r_regionkey AS c FROM region)),
    found AS (SELECT band, x, y, any_value(value) AS value, max(region) AS region FROM kept GROUP BY band, x, y)
    SELECT band, coalesce(region, -1) AS region, count(*) AS pixels, round(sum(value), 6) + 0 AS flux FROM found GROUP BY band, region""")
def region_flux(spark, sf_dir):
    """Flux of the bands' images in circles, and in the remainder as region -1."""
    key = F.col("r_regionkey")
    circles = read(spark, sf_dir, "region").select(key.alias("region"), (0.3 + 1.8 * key).alias("x"), F.lit(3.5).alias("y"), F.sqrt(0.64 * (1 + key % 2)).alias("radius"))
    parts = sky.split(bands_of(spark, sf_dir), sky.masks(sky.circle_spans(circles, 8, 8)))
    return rounded(parts.na.fill(-1, ["region"]).groupBy("band", "region").agg(F.count("*").alias("pixels"), F.sum("value").alias("flux")), "band", "region", "pixels")
