"""Operators that work alike on streams and on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_statistics(events: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, last, n, total): runs of events of a key that stand less than ``gap`` apart.

    events: key, ts (timestamp), value; other columns are ignored.  On a stream
    give ``late``, by how much events may come late; a run is then complete, and
    appended, once no event can join it.  Null keys form one key, rows with a null
    ts are left out, and null values count but add nothing.
    """
    rows = events.select(key, F.col("ts").cast("timestamp").alias("ts"), "value").filter("ts is not null")
    if late is not None:
        rows = rows.withWatermark("ts", late)
    runs = rows.groupBy(key, F.session_window("ts", gap).alias("run"))
    sums = runs.agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(key, F.col("run.start").alias("start"), "last", "n", "total")


def running_mean(rows: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """(keys, value, weight): mean of ``value`` by ``weight`` over all rows so far.

    On a stream the result is updated with every batch (output mode ``update`` or
    ``complete``), and the state is two sums for each key.  Null values count
    nothing.  With ``late`` the keys must hold a time window, and a window is
    final, and appended, once its rows can come no more.
    """
    if late is not None:
        rows = rows.withWatermark("ts", late)
    kept = rows.filter("value IS NOT NULL AND weight IS NOT NULL")
    w = F.sum("weight")
    return kept.groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) / F.nullif(w, F.lit(0.0))).alias("value"), w.alias("weight"))


def block_means(rows: DataFrame, keys: list[str], every: str, late: str | None = None) -> DataFrame:
    """(keys, start, value, weight, n, rms): weighted mean and deviation in blocks of time of length ``every``.

    rows: keys, ts (timestamp), value, weight.  On a stream give ``late``, by how
    much rows may come late; a block is appended once it is complete, and the state
    is four sums for each open block.  Rows with a null ts, value or weight are
    left out; a block without weight has a null mean.
    """
    kept = rows.select(*keys, F.col("ts").cast("timestamp").alias("ts"), "value", "weight").filter("ts IS NOT NULL AND value IS NOT NULL AND weight IS NOT NULL")
    if late is not None:
        kept = kept.withWatermark("ts", late)
    w, v = F.col("weight"), F.col("value")
    sums = kept.groupBy(*keys, F.window("ts", every).alias("block")).agg(F.sum(w * v).alias("wv"), F.sum(w).alias("weight"), F.count("*").alias("n"), F.stddev_pop(v).alias("rms"))
    return sums.select(*keys, F.col("block.start").alias("start"), (F.col("wv") / F.nullif(F.col("weight"), F.lit(0.0))).alias("value"), "weight", "n", "rms")
