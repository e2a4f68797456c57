"""Folders for what a job writes on its way; they are deleted when the session's Python ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Results are lazy and read such folders later, so these go only when Python ends with the session still there."""

    def gone() -> None:
        if spark.sparkContext._jsc is not None:
            try:
                remove(spark, path)
            except Exception:  # the JVM may have ended first; nothing is left to do then
                pass

    atexit.register(gone)


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where one machine runs everything."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="spanfold-")
    remove_at_exit(spark, folder)
    return folder


def scratch(spark: SparkSession, prefix: str) -> str:
    """A new path in the folder that the cluster shares."""
    path = f"{shared_root(spark)}/{prefix}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def written(frame: DataFrame, path: str) -> DataFrame:
    """The same rows as a table, for plans that read them several times."""
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)
