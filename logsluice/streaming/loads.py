"""Loads of log files: each file once, however often and by whichever load it is looked at.

A load first marks that it begins, then writes its rows into a folder of its own, then the files it took, then itself (see
``ledger``); only the last step makes the others count. What an interrupted load leaves behind is never shown: readers and published tables
know complete loads only. The next load deletes it and takes its files again. One load per lake at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.paths import Layout, folder_of, is_digest, scanned_file, with_path_values
from logsluice.schemas import LAKE_KEYS, RECORD
from logsluice.session import ensure_checkpoint_dir
from logsluice.sources.audit import UNREADABLE, read_envelopes
from logsluice.sources.lake import LOAD, write_lake
from logsluice.sources.paths import empty_if_missing
from logsluice.streaming import ledger
from logsluice.streaming.ledger import taken_files

#: Files, and compressed bytes, of one batch of a long backlog; each batch is a load that commits by itself.
BATCH_FILES = 100_000
BATCH_BYTES = 100 * 2**30

@dataclass
class Report:
    """What a call loaded: files taken, records in them, and files set aside with a problem."""

    files: int = 0
    records: int = 0
    problems: int = 0


def quarantined_files(spark: SparkSession, dest: str) -> DataFrame:
    """``path`` and ``problem`` of files that gave no records."""
    return taken_files(spark, dest).where("problem IS NOT NULL").select("path", "problem", "day")


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` and ``length`` of the files below ``paths``; none where nothing is there."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType())])
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return empty_if_missing(spark, lambda: reader.load(paths).select(scanned_file().alias("path"), "length"), schema)


def _with_day(files: DataFrame, layout: Layout) -> DataFrame:
    parts = with_path_values(files.withColumn("_folder", folder_of("path")), "_folder", layout)
    day = F.coalesce(F.concat_ws("-", *[F.col(c) for c in ("year", "month", "day")]), F.lit(""))
    return parts.withColumn("day", F.when(day != "", day).otherwise("none")).select(*files.columns, "day")


def _batches(files: DataFrame, most_files: int, most_bytes: int) -> Iterator[list[tuple[str, str]]]:
    batch: list[tuple[str, str]] = []
    size = 0
    for row in files.select("path", "day", "length").toLocalIterator():
        if batch and (len(batch) >= most_files or size + row["length"] > most_bytes):
            yield batch
            batch, size = [], 0
        batch.append((row["path"], row["day"]))
        size += row["length"]
    if batch:
        yield batch


def _literally(path: str) -> str:
    """A path without the meaning that globs give to some characters."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def load_files(
    spark: SparkSession, listed: DataFrame, dest: str, rows_of: Callable[[DataFrame], DataFrame], layout: Layout,
    keys: Sequence[str] = LAKE_KEYS, record: T.StructType = RECORD,
    batch_files: int = BATCH_FILES, batch_bytes: int = BATCH_BYTES,
) -> Report:
    """Load those of the ``listed`` files (``path``, ``length``) that the lake at ``dest`` has not taken.

    ``rows_of`` turns envelopes into lake rows. Files that cannot be read, are no JSON, or hold no records are set aside in
    ``quarantined_files``; the rest is loaded. The driver holds the paths of one batch at a time.
    """
    ensure_checkpoint_dir(spark)
    logs = _with_day(listed.where(~is_digest("path")), layout)
    ledger.undo_broken(spark, dest)
    days = [r["day"] for r in logs.select("day").distinct().collect()]
    new = logs.join(taken_files(spark, dest, days).select("path"), "path", "left_anti").checkpoint()
    report = Report()
    for batch in _batches(new, batch_files, batch_bytes):
        load = uuid.uuid4().hex
        ledger.start(spark, dest, load)
        envelopes = read_envelopes(spark, [_literally(path) for path, _ in batch], record).persist(StorageLevel.DISK_ONLY)
        try:
            write_lake(rows_of(envelopes), dest, keys, load)
            read = envelopes.select(F.col("_file").alias("path"), "problem", F.coalesce(F.size("Records"), F.lit(0)).cast("long").alias("records"))
            wanted = spark.createDataFrame(batch, "path string, day string")
            known = wanted.join(read.withColumn("_read", F.lit(True)), "path", "left").select(
                "path", F.when(F.col("_read").isNull(), UNREADABLE).otherwise(F.col("problem")).alias("problem"),
                F.when(F.col("records") > 0, F.col("records")).otherwise(F.lit(0)).cast("long").alias("records"), F.lit(load).alias(LOAD.name), "day",
            )
            known = known.checkpoint()
            ledger.add_files(known, dest)
            sums = known.agg(F.count("*"), F.sum("records"), F.count("problem")).first()
            ledger.finish(spark, dest, load, sums[0], sums[1] or 0)
        finally:
            envelopes.unpersist()
        report.files, report.records, report.problems = report.files + sums[0], report.records + (sums[1] or 0), report.problems + sums[2]
    if report.files:
        ledger.merge(spark, dest, days)
    return report
