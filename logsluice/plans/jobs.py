"""The jobs: four loads and two partition registrations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.paths import ACCOUNT_LAYOUT, Layout, recent_days
from logsluice.operators import partitions as P
from logsluice.operators.flatten import to_lake_rows, to_lake_rows_by_folder
from logsluice.plans.catalog import add_partitions, partition_values, publish_loads, registered_partitions, table_location
from logsluice.schemas import RECORD
from logsluice.session import ensure_checkpoint_dir
from logsluice.sources.audit import explode_records, lookback, month_slice, with_folder_keys
from logsluice.sources.manifest import account_folders, empty_locations, file_manifest, leaf_prefixes, month_folders
from logsluice.sources.paths import empty_if_missing
from logsluice.streaming.loads import Report, list_files, load_files


def convert_table(
    spark: SparkSession, table: str, dest: str, layout: Layout = ACCOUNT_LAYOUT, record: T.StructType = RECORD, **options: int
) -> Report:
    """Load all files of a catalog table that the lake has not taken, a slice at a time.

    Of a table whose partitions have a year and a month, a slice is a month's partitions, which the catalog alone is asked for.
    A table without partitions is walked by the month folders below its location; if there are none, it is one slice.
    """
    total = Report()
    for files in _table_slices(spark, table, layout):
        part = _load(spark, files, dest, False, layout, record, options)
        total = Report(total.files + part.files, total.records + part.records, total.problems + part.problems)
    return total


def _table_slices(spark: SparkSession, table: str, layout: Layout) -> Iterator[str | list[str]]:
    """Paths or globs that together hold all files of a table; of a month at most, where months can be told."""
    keys = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if {"year", "month"} <= set(keys):
        months = partition_values(spark, table, ("year", "month")).distinct()
        for year, month in sorted(map(tuple, months.collect())):
            yield spark.table(table).where((F.col("year") == year) & (F.col("month") == month)).inputFiles()
        return
    location = None if keys else table_location(spark, table)
    months = month_folders(spark, location, layout) if location else []
    if not months:
        yield spark.table(table).inputFiles()
    for year, month in months:
        yield layout.named_month_glob(location, year, month)


def publish(spark: SparkSession, table: str, dest: str) -> int:
    """Show a catalog table of the lake at ``dest`` the loads it lacks; meant to run after each load."""
    return publish_loads(spark, table, dest)


def backfill(
    spark: SparkSession, root: str, dest: str, layout: Layout = ACCOUNT_LAYOUT, record: T.StructType = RECORD, **options: int,
) -> Report:
    """Load every delivery day below ``root`` that the lake has not seen, month by month.

    ``options`` (``batch_files``, ``batch_bytes``) bound the batches of a backlog, here and in the other loads.
    """
    total = Report()
    for year, month in month_folders(spark, root, layout):
        part = _load(spark, layout.named_month_glob(root, year, month), dest, False, layout, record, options)
        total = Report(total.files + part.files, total.records + part.records, total.problems + part.problems)
    return total


def backfill_month(
    spark: SparkSession, root: str | None, dest: str, year: int, month: int, layout: Layout = ACCOUNT_LAYOUT,
    record: T.StructType = RECORD, table: str | None = None, **options: int,
) -> Report:
    """Load one delivery month; rows land by event time, also in the month before.

    The files are those below ``root``, or those of the partitions of ``table`` that this month names.
    """
    files = layout.month_glob(root, year, month) if table is None else month_slice(spark.table(table), year, month).inputFiles()
    return _load(spark, files, dest, True, layout, record, options)


def incremental(
    spark: SparkSession, root: str, dest: str, as_of: date, layout: Layout = ACCOUNT_LAYOUT, record: T.StructType = RECORD,
    **options: int,
) -> Report:
    """Load what is new in the folders of ``as_of`` and the day before; meant to run hourly."""
    return _load(spark, layout.days_glob(root, recent_days(as_of)), dest, False, layout, record, options)


def incremental_lookback(
    spark: SparkSession, root: str | None, dest: str, as_of: date, days: int = 7, layout: Layout = ACCOUNT_LAYOUT,
    record: T.StructType = RECORD, table: str | None = None, **options: int,
) -> Report:
    """Load what is new in the folders of the last ``days`` days, or in such partitions of ``table``."""
    glob = layout.days_glob(root, recent_days(as_of, days)) if table is None else lookback(spark.table(table), as_of, days).inputFiles()
    return _load(spark, glob, dest, True, layout, record, options)


def _load(
    spark: SparkSession, paths: str | list[str], dest: str, by_folder: bool, layout: Layout, record: T.StructType, options: dict
) -> Report:
    """Account and region come from the folder or, if not ``by_folder``, from the record itself."""

    def rows(envelopes: DataFrame) -> DataFrame:
        records = explode_records(envelopes)
        return to_lake_rows_by_folder(with_folder_keys(records, layout), record) if by_folder else to_lake_rows(records, record)

    if not paths:
        return Report()
    return load_files(spark, list_files(spark, paths), dest, rows, layout, record=record, **options)


def register_partitions(
    spark: SparkSession, root: str, table: str, layout: Layout = ACCOUNT_LAYOUT
) -> DataFrame:
    """Register every leaf folder below ``root``; returns the reconcile report.

    Folders are found month by month, so that no listing holds the files of the whole tree.
    """
    ensure_checkpoint_dir(spark)
    found = empty_locations(spark)
    for year, month in month_folders(spark, root, layout):
        glob = layout.named_month_glob(root, year, month)
        files = empty_if_missing(spark, lambda g=glob: file_manifest(spark, g), T.StructType().add("path", "string"))
        found = found.unionByName(leaf_prefixes(files).checkpoint())
    return _register(spark, table, P.well_formed(P.parse_locations(found, layout), layout), layout)


def register_recent(
    spark: SparkSession, root: str, table: str, as_of: date, layout: Layout = ACCOUNT_LAYOUT
) -> DataFrame:
    """Register today and yesterday for every account and region that has a folder below ``root``.

    The catalog is asked for the partitions of these days only, and the report is about them.
    """
    pairs = account_folders(spark, root, layout)
    wanted = P.candidate_locations(pairs, as_of, root, layout)
    return _register(spark, table, P.parse_locations(wanted, layout), layout, recent_days(as_of))


def _register(
    spark: SparkSession, table: str, found: DataFrame, layout: Layout, days: Sequence[date] | None = None
) -> DataFrame:
    """``days``: only partitions of these days are looked at in the catalog."""
    keys = list(layout.keys)
    before = registered_partitions(spark, table, layout, days)
    unique = found.groupBy(*keys).agg(F.min("location").alias("location"))
    # Fixed before the catalog changes, so the report counts what was really sent.
    ensure_checkpoint_dir(spark)
    new = P.new_partitions(unique, before, keys).checkpoint()
    add_partitions(spark, table, new, keys)
    after = registered_partitions(spark, table, layout, days)
    named = [f.select(F.concat_ws("/", *keys).alias("location")) for f in (before, new, after)]
    return P.reconcile(*named)
