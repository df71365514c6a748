"""Folders of tables in any store that Spark writes to: what is whole, what goes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def path_of(spark: SparkSession, where: str):
    """Hadoop's path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_whole(spark: SparkSession, where: str) -> bool:
    """Whether a write to that folder ended well."""
    path, fs = path_of(spark, f"{where}/_SUCCESS")
    return fs.exists(path)


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = path_of(spark, where)
    return fs.exists(path)


def below(spark: SparkSession, where: str) -> list[str]:
    """Names of the folders in a folder; none where there is no such folder."""
    path, fs = path_of(spark, where)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def remove(spark: SparkSession, where: str) -> None:
    path, fs = path_of(spark, where)
    fs.delete(path, True)


def n_bytes(spark: SparkSession, where: str) -> int:
    path, fs = path_of(spark, where)
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def shared(spark: SparkSession, name: str) -> str:
    """A path below the folder that driver and executors share."""
    from tessera.session import checkpoint_folder

    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
