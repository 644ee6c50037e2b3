"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where that is unset and all runs here, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='offerlane-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder; False if there was none."""
    fs, at = hadoop_path(spark, path)
    return bool(fs.delete(at, True))


def until_exit(spark: SparkSession, path: str) -> str:
    """path, a folder that is made now and removed when the application ends."""
    fs, at = hadoop_path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def kept(df: DataFrame, path: str) -> DataFrame:
    """df written at path and read again: later work doesn't run its plan anew, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
