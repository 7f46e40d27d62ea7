"""Scans: measurement tables, their dimensions, gains and stand-ins for them.

A measurement set is a Parquet table partitioned by (field_id, ddid, scan).  The
``*_of`` functions project the star-schema tables onto the roles of an
interferometer; every query states the same projection in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epoch_seconds

#: Columns of a visibility table that a scan may ask for.
VIS_COLUMNS = ("row_id", "field_id", "ddid", "scan", "time", "ant1", "ant2", "u", "v", "w", "chan", "freq", "corr", "re", "im", "weight", "sigma", "flag", "model_re", "model_im")

#: The same projection in SQL.
VIS_SQL = """vis AS (SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS row_id,
    CAST(l_partkey % 4 AS INT) AS field_id, CAST(l_linenumber % 2 AS INT) AS ddid, CAST(l_orderkey % 5 AS INT) AS scan,
    epoch(l_shipdate) AS time, CAST(l_suppkey % 16 AS INT) AS ant1, CAST(l_partkey % 16 AS INT) AS ant2,
    (l_quantity - 25.5e0) * 40 AS u, CAST((l_partkey % 101) - 50 AS DOUBLE) * 20 AS v, CAST((l_suppkey % 11) - 5 AS DOUBLE) * 4 AS w,
    CAST(l_linenumber AS INT) AS chan, 1e9 + 1e7 * l_linenumber AS freq,
    CASE WHEN l_returnflag = 'R' THEN 'XX' WHEN l_returnflag = 'A' THEN 'XY' WHEN l_linestatus = 'F' THEN 'YX' ELSE 'YY' END AS corr,
    l_discount - 0.05e0 AS re, l_tax - 0.04e0 AS im, 0.01e0 + l_quantity / 50 AS weight,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 0.5e0 + l_tax END AS sigma, l_quantity > 48 AS flag,
    l_discount * 0.5e0 AS model_re, l_tax * 0.5e0 AS model_im FROM lineitem)"""

CUBE_SQL = """cube AS (SELECT vec_id, CAST(label AS INT) AS band, CAST(i // 8 AS INT) AS x, CAST(i % 8 AS INT) AS y, CAST(embedding[i + 1] AS DOUBLE) AS value
    FROM embeddings, (SELECT unnest(range(64)) AS i))"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vis_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibilities from ``lineitem``; only the columns a query uses reach the scan."""
    t = read(spark, sf_dir, "lineitem")
    key, tax, disc, qty = F.col("l_partkey"), F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    corr = F.when(F.col("l_returnflag") == "R", "XX").when(F.col("l_returnflag") == "A", "XY").when(F.col("l_linestatus") == "F", "YX").otherwise("YY")
    return t.select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + key) * 10000 + F.col("l_suppkey")).alias("row_id"),
        (key % 4).cast("int").alias("field_id"), (F.col("l_linenumber") % 2).cast("int").alias("ddid"), (F.col("l_orderkey") % 5).cast("int").alias("scan"),
        epoch_seconds("l_shipdate").alias("time"), (F.col("l_suppkey") % 16).cast("int").alias("ant1"), (key % 16).cast("int").alias("ant2"),
        ((qty - 25.5) * 40).alias("u"), (((key % 101) - 50).cast("double") * 20).alias("v"), (((F.col("l_suppkey") % 11) - 5).cast("double") * 4).alias("w"),
        F.col("l_linenumber").cast("int").alias("chan"), (1e9 + 1e7 * F.col("l_linenumber")).alias("freq"), corr.alias("corr"),
        (disc - 0.05).alias("re"), (tax - 0.04).alias("im"), (0.01 + qty / 50).alias("weight"),
        F.when(key % 5 != 0, 0.5 + tax).alias("sigma"), (qty > 48).alias("flag"), (disc * 0.5).alias("model_re"), (tax * 0.5).alias("model_im"),
    )


def cube_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image cubes from ``embeddings``: 8 x 8 pixels each, one per vector, the label as the band."""
    t = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("band"), F.posexplode("embedding").alias("i", "value"))
    return t.select("vec_id", "band", F.floor(F.col("i") / 8).cast("int").alias("x"), (F.col("i") % 8).cast("int").alias("y"), F.col("value").cast("double").alias("value"))


def scan_vis(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Measurement sets as one table: paths may be globs; partition columns and ``ms`` (the file's set) come along."""
    paths = [paths] if isinstance(paths, str) else paths
    df = spark.read.option("mergeSchema", "false").parquet(*paths) if len(paths) == 1 else _union(spark, paths)
    df = df.withColumn("ms", F.regexp_extract(F.input_file_name(), r"([^/]+)/(?:field_id=|[^/]+\.parquet$)", 1))
    return df.select(*columns, "ms") if columns else df


def _union(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def polarisation(corr_types: Column) -> Column:
    """Feed type of an array of correlation codes: linear (9-12), circular (5-8), else null."""
    inside = lambda lo, hi: F.size(F.array_except(corr_types, F.array(*map(F.lit, range(lo, hi + 1))))) == 0
    return F.when(F.size(corr_types) == 0, F.lit(None)).when(inside(9, 12), "linear").when(inside(5, 8), "circular")


def check_alignment(vis: DataFrame, gains: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the visibilities that the gain table lacks; empty if they are aligned."""
    return vis.select(*keys).distinct().join(gains.select(*keys).distinct(), keys, "left_anti")


def write_vis(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Sink of a visibility table by (field_id, ddid, scan); refuses to overwrite unless told to."""
    df.write.partitionBy("field_id", "ddid", "scan").mode("overwrite" if overwrite else "errorifexists").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_images(df: DataFrame, path: str, iteration: int) -> None:
    """Appends an iteration's images; earlier iterations stay as they are."""
    df.withColumn("iteration", F.lit(iteration)).write.partitionBy("product", "iteration").mode("append").parquet(path)


def latest_images(spark: SparkSession, path: str) -> DataFrame:
    """The images of each product's last iteration."""
    df = spark.read.parquet(path)
    last = df.groupBy("product").agg(F.max("iteration").alias("iteration"))
    return df.join(F.broadcast(last), ["product", "iteration"])  # one row for each product


def accumulate(vis: DataFrame, predicted: DataFrame, keys: list[str], add: bool = True) -> DataFrame:
    """Column write-back of predicted visibilities, added to what is there or replacing it."""
    p = predicted.select(*keys, F.col("re").alias("p_re"), F.col("im").alias("p_im"))
    base = (lambda c: F.col(c)) if add else (lambda c: F.lit(0.0))
    return vis.join(p, keys, "left").withColumn("re", base("re") + F.coalesce("p_re", F.lit(0.0))).withColumn("im", base("im") + F.coalesce("p_im", F.lit(0.0))).drop("p_re", "p_im")
