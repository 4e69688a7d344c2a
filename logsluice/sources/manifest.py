"""Manifests of storage paths, listed by Spark rather than by a client library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.functions.paths import Layout, folder_of, is_digest, unescaped


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path")


def leaf_prefixes(files: DataFrame) -> DataFrame:
    """``location`` of every folder with files and no sub-folder, digests left out.

    The list is cut to distinct folders before anything else, so the shuffle carries folders,
    not files.
    """
    folders = files.where(~is_digest("path")).select(folder_of("path").alias("location")).distinct()
    parts = F.split(F.rtrim("location", F.lit("/")), "/")
    parents = folders.where(F.size(parts) > 1).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")),
            )
        ).alias("location")
    ).distinct()
    return folders.join(parents, "location", "left_anti")


def _folders(spark: SparkSession, glob: str) -> list[str]:
    """Paths of the folders a glob matches, asked from the store; files in them are not listed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [] if f.isDirectory())


def month_folders(spark: SparkSession, root: str, layout: Layout) -> list[tuple[str, str]]:
    """Names of the year and month folders below ``root``, in order."""
    return sorted({tuple(f.rsplit("/", 2)[1:]) for f in _folders(spark, layout.months_glob(root))})


def account_folders(spark: SparkSession, root: str, layout: Layout) -> DataFrame:
    """``account`` and ``region`` of every region folder below ``root``."""
    depth = len(layout.folders.split("/"))
    names = [f.rsplit("/", depth)[1:] for f in _folders(spark, layout.any_folder(root))]
    rows = [(n[0].split("=", 1)[-1], n[-1].split("=", 1)[-1]) for n in names]
    pairs = spark.createDataFrame(rows, "account string, region string")
    return pairs.select(*[unescaped(F.col(c)).alias(c) for c in pairs.columns]) if layout.named else pairs


def empty_locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "location string")
