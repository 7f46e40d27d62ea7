"""Queries on measurement sets that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import VIS_SQL, vis_of, write_vis
from ..sources.measurement import scan_sets
from .registry import query, rounded
from .tables import temporary

_KEYS = ("field_id", "ddid", "scan")


def _set_of(spark, sf_dir, name):
    """All visibilities as a set in the shared folder; its path."""
    path = f"{temporary(spark, 'sets')}/{name}"
    write_vis(vis_of(spark, sf_dir).repartition(*_KEYS), path)
    return path


@query(f"""WITH {VIS_SQL} SELECT 'target' AS ms, field_id, ddid, scan, chan, count(*) AS n, round(sum(CASE WHEN flag THEN 0 ELSE weight * re END), 6) + 0 AS re, round(sum(CASE WHEN flag THEN 0 ELSE weight * im END), 6) + 0 AS im,
    count(sigma) AS sigmas FROM vis GROUP BY ALL""")
def measurement_set_scan(spark, sf_dir):
    """Weighted sums of a set by its folders and channels, read by the format of measurement sets."""
    vis = scan_sets(spark, _set_of(spark, sf_dir, "target"), ["ms", *_KEYS, "chan", "weight", "re", "im", "flag", "sigma"])
    term = lambda c: F.sum(F.when(F.col("flag"), 0.0).otherwise(F.col("weight") * F.col(c))).alias(c)
    sums = vis.groupBy("ms", *_KEYS, "chan").agg(F.count("*").alias("n"), term("re"), term("im"), F.count("sigma").alias("sigmas"))
    return rounded(sums, "ms", *_KEYS, "chan", "n", "sigmas")


@query(f"""WITH {VIS_SQL} SELECT field_id, scan, corr, count(*) AS n, round(sum(u * re - v * im), 6) + 0 AS total, min(time) AS first, max(time) AS last
    FROM vis WHERE field_id IN (1, 3) AND ddid = 1 AND scan >= 2 AND chan BETWEEN 3 AND 5 AND freq < 1.045e9 AND ant1 <> ant2 GROUP BY ALL""")
def measurement_set_selection(spark, sf_dir):
    """Fields, bands, scans and frequencies chosen: folders by the list of files, row groups by their statistics."""
    vis = scan_sets(spark, _set_of(spark, sf_dir, "target"))
    chosen = vis.filter("field_id in (1, 3) and ddid = 1 and scan >= 2 and chan between 3 and 5 and freq < 1.045e9 and ant1 <> ant2")
    sums = chosen.groupBy("field_id", "scan", "corr").agg(F.count("*").alias("n"), F.sum(F.expr("u * re - v * im")).alias("total"), F.min("time").alias("first"), F.max("time").alias("last"))
    return rounded(sums, "field_id", "scan", "corr", "n", "first", "last")
