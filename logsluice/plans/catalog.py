"""Databases, external tables and their partitions, through plain SQL."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from datetime import date
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.paths import ACCOUNT_LAYOUT, Layout, folder_of, unescaped
from logsluice.functions.text import not_blank
from logsluice.schemas import DELIVERED_KEYS, DELIMITED_PRICES, LAKE_KEYS, envelope_schema, lake_schema
from logsluice.sources.lake import LOAD, load_folder
from logsluice.sources.manifest import file_manifest
from logsluice.sources.paths import empty_if_missing
from logsluice.streaming.ledger import complete_loads

# Fixed value: what a folder is called whose key is NULL.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

# Partition clauses per statement; a statement is one catalog call.
CLAUSES_PER_STATEMENT = 100


def quoted(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_database(
    spark: SparkSession, name: str, location: str | None = None, if_not_exists: bool = True
) -> None:
    guard = "IF NOT EXISTS " if if_not_exists else ""
    where = f" LOCATION {quoted(location)}" if location else ""
    spark.sql(f"CREATE DATABASE {guard}`{name}`{where}")


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def create_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    using: str,
    location: str | None = None,
    keys: Iterable[str] = (),
    **options: str,
) -> None:
    """``CREATE TABLE`` with an explicit schema; external when ``location`` is given."""
    text = f"CREATE TABLE IF NOT EXISTS {table} ({_columns(schema)}) USING {using}"
    if options:
        text += " OPTIONS (" + ", ".join(f"{quoted(k)} {quoted(v)}" for k, v in options.items()) + ")"
    if keys:
        text += " PARTITIONED BY (" + ", ".join(f"`{k}`" for k in keys) + ")"
    if location:
        text += f" LOCATION {quoted(location)}"
    spark.sql(text)


def create_flat_log_table(spark: SparkSession, table: str, location: str) -> None:
    """Envelopes below ``location``, however deep, as one table."""
    create_table(
        spark, table, envelope_schema(), "json", location,
        multiLine="true", recursiveFileLookup="true", ignoreCorruptFiles="true",
    )


def create_partitioned_log_table(spark: SparkSession, table: str, location: str) -> None:
    """Envelopes by delivery folder; ``add_partitions`` points its keys at the folders."""
    keys = [T.StructField(key, T.StringType()) for key in DELIVERED_KEYS]
    schema = T.StructType([*envelope_schema().fields, *keys])
    create_table(spark, table, schema, "json", location, DELIVERED_KEYS, multiLine="true", ignoreCorruptFiles="true")


def create_lake_table(
    spark: SparkSession, table: str, location: str, keys: Iterable[str] = (LOAD.name, *LAKE_KEYS)
) -> None:
    """A partitioned table over a lake. ``publish_loads`` shows it what loads have written.

    For a lake that was written directly, without loads, give its own ``keys`` and use ``recover_partitions``.
    """
    schema = T.StructType([*lake_schema().fields, *([LOAD] if LOAD.name in keys else [])])
    create_table(spark, table, schema, "parquet", location, keys)


def published_folder(location: str, table: str) -> str:
    return f"{location.rstrip('/')}/_published/{table}"


def publish_loads(spark: SparkSession, table: str, location: str, keys: Sequence[str] = LAKE_KEYS) -> int:
    """Add the partitions of every complete load that ``table`` does not show yet; returns how many loads these were.

    A load's partitions lie in its own folder, which is all that is listed. So the table never shows rows of a load that is
    under way or broke off, and a record that was loaded again is there once. What has been published is noted beside the lake, after the
    partitions were added; to add them again does no harm.
    """
    known = published_folder(location, table)
    seen = empty_if_missing(spark, lambda: spark.read.schema(T.StructType([LOAD])).parquet(known), T.StructType([LOAD]))
    new = [r[0] for r in complete_loads(spark, location).join(seen, LOAD.name, "left_anti").select(LOAD.name, "at").orderBy("at").collect()]
    for load in new:
        folder = load_folder(location, load)
        files = empty_if_missing(spark, lambda f=folder: file_manifest(spark, f), T.StructType().add("path", "string"))
        leaves = files.select(folder_of("path").alias("location")).distinct()
        values = {k: F.regexp_extract("location", f"/{k}=([^/]*)/", 1) for k in keys}
        located = leaves.select(
            "location", F.lit(load).alias(LOAD.name),
            *[F.when(v != NO_VALUE, unescaped(v)).alias(k) for k, v in values.items()],
        )
        add_partitions(spark, table, located, (LOAD.name, *keys))
    if new:
        noted = spark.createDataFrame([(load,) for load in new], T.StructType([LOAD]))
        noted.coalesce(1).write.mode("append").parquet(known)
    return len(new)


def recover_partitions(spark: SparkSession, table: str) -> None:
    """Register every ``key=value`` folder of a table."""
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def create_price_table(spark: SparkSession, table: str, location: str) -> None:
    """The pipe-delimited price table."""
    create_table(spark, table, DELIMITED_PRICES, "csv", location, sep="|", header="true", quote="")


def registered_partitions(
    spark: SparkSession, table: str, layout: Layout = ACCOUNT_LAYOUT, days: Iterable[date] | None = None
) -> DataFrame:
    """The key values of a table's partitions, one column per key; of all, or of the partitions of some ``days`` only."""
    only = [""] if days is None else [
        f" PARTITION (year = '{d:%Y}', month = '{d:%m}', day = '{d:%d}')" for d in sorted(set(days))
    ]
    return reduce(DataFrame.union, [partition_values(spark, table, layout.keys, part) for part in only])


def partition_values(spark: SparkSession, table: str, keys: Iterable[str], part: str = "") -> DataFrame:
    """Some keys of a table's partitions, of all or of the given ``PARTITION (...)``."""
    values = {k: F.regexp_extract("partition", f"(?:^|/){k}=([^/]*)", 1) for k in keys}
    return spark.sql(f"SHOW PARTITIONS {table}{part}").select(*[unescaped(v).alias(k) for k, v in values.items()])


def table_location(spark: SparkSession, table: str) -> str | None:
    """Where an external table's files are; None if that is a glob or not known."""
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()
    return None if row is None or re.search(r"[{}\[\]*?]", row["data_type"]) else row["data_type"]


def add_partitions(
    spark: SparkSession, table: str, located: DataFrame, keys: Iterable[str] = DELIVERED_KEYS
) -> int:
    """Register ``located`` (key columns and ``location``); returns the number of clauses sent.

    The catalog takes statements, so the rows do pass the driver, but only a statement's worth
    at a time.
    """
    keys = tuple(keys)
    rows: Iterator = located.select(*keys, "location").toLocalIterator()
    sent = 0
    while clauses := [_clause(row, keys) for row in islice(rows, CLAUSES_PER_STATEMENT)]:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(clauses))
        sent += len(clauses)
    return sent


def _clause(row, keys: tuple[str, ...]) -> str:
    values = ", ".join(f"`{k}` = {'NULL' if row[k] is None else quoted(row[k])}" for k in keys)
    return f"PARTITION ({values}) LOCATION {quoted(row['location'])}"


def preview(spark: SparkSession, table: str) -> DataFrame:
    """Ten rows of a table, in no particular order."""
    return spark.sql(f"SELECT * FROM {table} LIMIT 10")


def endpoint_access(spark: SparkSession, table: str, column: str = "vpc_endpoint_id") -> DataFrame:
    """Saved query: events that came through a private endpoint."""
    return spark.table(table).where(not_blank(column) & F.col(column).isNotNull())
