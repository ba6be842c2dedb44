"""Paths on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, store = _opened(spark, path)
    return bool(store.exists(hadoop))


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder; none if there is no such folder."""
    hadoop, store = _opened(spark, path)
    return sorted(f.getPath().toString() for f in store.listStatus(hadoop) if f.isDirectory()) if store.exists(hadoop) else []


def delete(spark: SparkSession, path: str) -> None:
    hadoop, store = _opened(spark, path)
    store.delete(hadoop, True)
