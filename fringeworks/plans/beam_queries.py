"""Queries on beams, on partitions at a glance and on blocks of time."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from ..operators import beams
from ..sources import VIS_SQL, read, vis_of
from .image_queries import BANDS, BXY, bands_of
from .registry import query, rounded

_R = f"({beams.SCALE!r} * sqrt(l * l + m * m) * freq / {1e9 * beams.WIDTH_AT_1GHZ!r})"


def _pixels(table):
    """Pixels a quarter of a degree wide, and the frequency of their band."""
    return table.withColumns({"l": (F.col("x") - 4) * 0.25, "m": (F.col("y") - 4) * 0.25, "freq": 1.0e9 + 1.0e7 * F.col("band")})


_PLACED = "placed AS (SELECT *, (x - 4) * 0.25e0 AS l, (y - 4) * 0.25e0 AS m, 1e9 + 1e7 * band AS freq FROM bands)"
_POWER = f"pow(CASE WHEN abs(1 - 4 * {_R} * {_R}) < 1e-9 THEN {pi / 4!r} ELSE cos({pi!r} * {_R}) / (1 - 4 * {_R} * {_R}) END, 2)"


@query(f"{BANDS}, {_PLACED} SELECT band, x, y, round({_POWER}, 6) + 0 AS beam, round(value * {_POWER}, 6) + 0 AS apparent FROM placed")
def cosine_beam(spark, sf_dir):
    """The cosine-tapered beam of each band, and the images through it."""
    b = _pixels(bands_of(spark, sf_dir)).withColumn("beam", beams.cosine_beam(F.col("l"), F.col("m"), F.col("freq")))
    return rounded(b.select(*BXY, "beam", (F.col("value") * F.col("beam")).alias("apparent")), *BXY)


@query(f"{BANDS}, {_PLACED} SELECT band, x, y, round(value * {_POWER} / ({_POWER} * {_POWER} + 0.1e0), 6) + 0 AS value FROM placed")
def beam_divided(spark, sf_dir):
    b = _pixels(bands_of(spark, sf_dir)).withColumn("beam", beams.cosine_beam(F.col("l"), F.col("m"), F.col("freq")))
    return rounded(beams.divided(b.select(*BXY, "value"), b, BXY, 0.1), *BXY)


@query(f"""{BANDS}, beam AS (SELECT 1e9 + 1e7 * band AS freq, x, y, value FROM bands), knots AS (SELECT DISTINCT freq FROM beam), t AS (SELECT CAST(n_nationkey AS INT) AS channel, 0.99e9 + 5e6 * n_nationkey AS f FROM nation),
    spans AS (SELECT channel, f, max(freq) FILTER (freq <= f) AS lo, min(freq) FILTER (freq >= f) AS hi FROM t, knots GROUP BY channel, f)
    SELECT channel, a.x, a.y, round(a.value + CASE WHEN lo = hi THEN 0 ELSE (f - lo) / (hi - lo) END * (b.value - a.value), 6) + 0 AS value
    FROM spans JOIN beam a ON a.freq = lo JOIN beam b ON b.freq = hi AND a.x = b.x AND a.y = b.y""")
def beam_between_planes(spark, sf_dir):
    """Channels on, between and beyond the planes."""
    planes = _pixels(bands_of(spark, sf_dir)).select("freq", "x", "y", "value")
    channels = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("channel"), (0.99e9 + 5.0e6 * F.col("n_nationkey")).alias("freq"))
    return rounded(beams.at_frequencies(planes, channels, ["channel"]), "channel", "x", "y")


@query(f"""WITH {VIS_SQL}, ants AS (SELECT field_id, ddid, scan, string_agg(CAST(ant AS VARCHAR), ',' ORDER BY ant) AS antennas, CAST(count(*) AS INT) AS n_ant
    FROM (SELECT field_id, ddid, scan, ant1 AS ant FROM vis UNION SELECT field_id, ddid, scan, ant2 FROM vis) GROUP BY ALL)
    SELECT field_id, ddid, scan, min(time) AS first, max(time) AS last, min(freq) AS lowest, max(freq) AS highest, count(*) AS samples, count(*) FILTER (flag) AS flagged, n_ant, antennas
    FROM vis JOIN ants USING (field_id, ddid, scan) GROUP BY field_id, ddid, scan, n_ant, antennas""")
def partition_summary(spark, sf_dir):
    return beams.summary(vis_of(spark, sf_dir), ["field_id", "ddid", "scan"])


@query("""SELECT user_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, round(sum(value * w) / sum(w), 6) + 0 AS value, sum(w) AS weight, count(*) AS n, round(stddev_pop(value), 6) + 0 AS rms
    FROM (SELECT *, 1e0 + user_id % 3 AS w FROM events WHERE value IS NOT NULL) GROUP BY user_id, floor(epoch(ts) / 86400)""")
def time_block_means(spark, sf_dir):
    """A user's events by days."""
    from ..streaming import block_means

    rows = read(spark, sf_dir, "events")
    # the table's times have no zone: blocks are laid as in one without an offset
    utc = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"))
    out = block_means(rows.select("user_id", utc.alias("ts"), "value", (1.0 + F.col("user_id") % 3).alias("weight")), ["user_id"], "1 day")
    return rounded(out.withColumn("start", F.unix_seconds("start")), "user_id", "start", "n")


@query("""SELECT user_id, CAST(floor((place - 1) / 5) AS BIGINT) AS block, min(time) AS first, max(time) AS last, count(*) AS integrations, CAST(sum(n) AS BIGINT) AS samples, sum(w) AS weight, round(sum(wv) / sum(w), 6) + 0 AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time) AS place FROM (SELECT user_id, floor(epoch(ts) / 3600) AS time, sum(value * w) AS wv, sum(w) AS w, count(*) AS n
        FROM (SELECT *, 1e0 + user_id % 3 AS w FROM events WHERE value IS NOT NULL) GROUP BY user_id, floor(epoch(ts) / 3600)))
    GROUP BY user_id, floor((place - 1) / 5)""")
def count_block_means(spark, sf_dir):
    """A user's events in blocks of five hours that have any."""
    from ..functions import epoch_seconds
    from ..streaming.counted import count_blocks

    rows = read(spark, sf_dir, "events").select("user_id", F.floor(epoch_seconds("ts") / 3600).alias("time"), "value", (1.0 + F.col("user_id") % 3).alias("weight"))
    return rounded(count_blocks(rows, ["user_id"], 5), "user_id", "block", "integrations", "samples")
