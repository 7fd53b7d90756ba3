"""Folders that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used in local mode only, where the driver and all tasks share one disk.
LOCAL_FOLDER = "file:///tmp/checkpoints/mobilis"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new path below ``spark.checkpoint.dir``, in the folder of this application; local sessions without one get their own.

    What lies there serves one application: its folder goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_FOLDER
    home = f"{root.rstrip('/')}/{kind}/{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{home}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """Write a table to a shared folder and read it: later plans begin at its files."""
    path = new_folder(rows.sparkSession, "tables")
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def landed(rows: DataFrame, folder: str) -> None:
    """Land a slice of a feed in its folder, as many files as its rows have partitions."""
    rows.write.mode("append").parquet(folder)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the finished tables below a folder, in order (one name a version, a driver-side listing)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [(x.getPath().getName(), x.getPath()) for x in files.listStatus(place)]
    done = [int(n) for n, path in names if n.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))]
    return sorted(done)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a table that no later reader needs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
