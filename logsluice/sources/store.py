"""Names in a store, through the file system that Spark itself uses for a path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _at(spark, path)
    return store.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds itself, nothing below that; none if it is not there."""
    store, place = _at(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(place)) if store.exists(place) else []


def put_mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    store, place = _at(spark, path)
    store.create(place, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder and what is in it, if it is there."""
    store, place = _at(spark, path)
    store.delete(place, True)
