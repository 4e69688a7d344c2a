"""Readers for audit-log envelopes: files, and catalog tables over them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.paths import ACCOUNT_LAYOUT, Layout, folder_of, is_digest, scanned_file, with_path_values
from logsluice.functions.timeparts import from_day, partition_date
from logsluice.schemas import RECORD, envelope_schema
from logsluice.sources.paths import empty_if_missing

# The two spellings of one key; records of both kinds are read alike.
SHARED, OTHER_SHARED = "sharedEventID", "sharedEventId"

#: Why a file gave no records.
UNREADABLE, NOT_JSON, NO_RECORDS = "unreadable", "not JSON", "no records"


def read_envelopes(spark: SparkSession, paths: str | list[str], record: T.StructType = RECORD) -> DataFrame:
    """Envelope files below ``paths`` (globs allowed): ``_file``, ``problem`` and ``Records`` of each.

    A file that is no JSON or has no ``Records`` gives a row with a ``problem`` instead of failing the read; one that cannot be
    decompressed gives no row at all (see ``unreadable``). Compressed files cannot be split, so parallelism is the number of files.
    """
    reader = spark.read.options(wholetext="true", recursiveFileLookup="true", ignoreCorruptFiles="true")
    texts = reader.text(paths).select(scanned_file().alias("_file"), F.col("value").alias("_text"))
    broken = T.StructField("_broken", T.StringType())
    schema = T.StructType([*envelope_schema(record).fields, broken])
    parsed = texts.select(
        "_file", "_text", F.from_json("_text", schema, {"columnNameOfCorruptRecord": "_broken"}).alias("_e")
    )
    records, problem = F.col("_e.Records"), F.when(F.col("_e").isNull() | F.col("_e._broken").isNotNull(), NOT_JSON)
    if SHARED in record.fieldNames():
        # Names that differ only by case cannot stand in one schema; texts with the other one are read for it again.
        other = T.StructType([T.StructField("Records", T.ArrayType(T.StructType([T.StructField(OTHER_SHARED, T.StringType())])))])
        again = F.when(F.col("_text").contains(f'"{OTHER_SHARED}"'), F.from_json("_text", other)["Records"])
        parsed = parsed.withColumn("_again", again)
        # Zipped before, as what a function of elements names from outside may be computed for each of them.
        both = F.transform(
            F.arrays_zip(records.alias("r"), F.col("_again").alias("o")),
            lambda x: x["r"].withField(SHARED, F.coalesce(x["r"][SHARED], x["o"][OTHER_SHARED])),
        )
        records = F.when(F.col("_again").isNull(), records).otherwise(both)
    problem = F.coalesce(problem, F.when(F.col("_e.Records").isNull(), NO_RECORDS))
    return parsed.select("_file", problem.alias("problem"), F.when(problem.isNull(), records).alias("Records"))


def explode_records(envelopes: DataFrame) -> DataFrame:
    """One row per audit record, with the file it came from; digest files are left out."""
    return (
        envelopes.where(~is_digest("_file"))
        .select("_file", F.explode("Records").alias("record"))
        .select("_file", "record.*")
    )


def with_folder_keys(records: DataFrame, layout: Layout = ACCOUNT_LAYOUT) -> DataFrame:
    """Add the account and region of the folder a record was delivered to."""
    delivered = with_path_values(
        records.select(folder_of("_file").alias("_folder"), F.struct("*").alias("_record")), "_folder", layout
    )
    return delivered.select("_record.*", F.col("accountid").alias("_account"), F.col("region").alias("_region"))


def scan_table(spark: SparkSession, table: str) -> DataFrame:
    """Records of a flat or partitioned catalog table of envelopes, with its partition keys, without digests."""
    envelopes = spark.table(table)
    keys = [c for c in envelopes.columns if c != "Records"]
    logs = envelopes.where(~is_digest(F.col("_metadata.file_path")))
    return logs.select(*keys, F.explode("Records").alias("record")).select(*keys, "record.*")


def table_problems(spark: SparkSession, table: str) -> DataFrame:
    """Files of such a table that give no records, being broken or something else; ``scan_table`` passes over them."""
    files = spark.table(table).select(scanned_file().alias("_file"), "Records")
    return files.where(F.col("Records").isNull() & ~is_digest("_file")).select("_file")


def month_slice(frame: DataFrame, year: int, month: int) -> DataFrame:
    """Rows of one ``year``/``month`` partition slice; the month key is zero-padded text."""
    return frame.where((F.col("year") == f"{year}") & (F.col("month") == f"{month:02d}"))


def lookback(frame: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Rows whose date partition is at most ``days`` days before ``as_of``, or later.

    The keys are compared as they are, so a metastore hands over the partitions of these days only; of them,
    those that name no date are left out.
    """
    first = as_of - timedelta(days=days)
    return frame.where(from_day(first) & (partition_date() >= F.lit(first)))


def read_days(
    spark: SparkSession, root: str, days: list[date], layout: Layout = ACCOUNT_LAYOUT, record=RECORD
) -> DataFrame:
    """Records of the given delivery days for every account and region; none where no folder is there."""
    schema = T.StructType([T.StructField("_file", T.StringType()), *record.fields])
    days_glob = layout.days_glob(root, days)
    return empty_if_missing(spark, lambda: explode_records(read_envelopes(spark, days_glob, record)), schema)
