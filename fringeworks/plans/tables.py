"""Tables in the folder that the driver and the executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Where the tables lie that this process has stored.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_EVERY: dict[str, None] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fringeworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder for files that ``release`` deletes."""
    path = new_folder(spark, name)
    _EVERY[path] = None
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, and safe from lost executors.

    ``discard`` deletes such a table as soon as nothing reads it; ``release``
    deletes all of a session, once its results are written.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    _EVERY[path] = None
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, _FOLDERS.pop(df))


def release(spark: SparkSession) -> None:
    """Deletes every table stored so far and not discarded; results that are not written yet are lost."""
    for path in list(_EVERY):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _EVERY.pop(path, None)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
