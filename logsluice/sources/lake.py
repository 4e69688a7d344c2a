"""The Parquet lake: event-time partitions, text keys kept as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.schemas import LAKE_KEYS, lake_schema
from logsluice.session import many_writers
from logsluice.sources.paths import empty_if_missing

#: Which load wrote a row: the first key of a lake that loads fill. Rows written without a load have none.
LOAD = T.StructField("load_id", T.StringType())
#: A row for each load that is complete.
LOADS = T.StructType(
    [LOAD, T.StructField("at", T.TimestampType()), T.StructField("files", T.LongType()), T.StructField("records", T.LongType())]
)


def spread_by_keys(frame: DataFrame, keys: Sequence[str] = LAKE_KEYS) -> DataFrame:
    """Bring the rows of one lake partition together before a write, for few files per partition.

    REBALANCE lets adaptive execution split a hot partition over several tasks, so one busy
    account does not end up in one writer. A table without partitions needs no shuffle.
    """
    return frame.hint("rebalance", *keys) if keys else frame


def write_lake(frame: DataFrame, dest: str, keys: Sequence[str] = LAKE_KEYS, load: str | None = None) -> None:
    """Append ``frame`` to the lake at ``dest``; an empty frame adds no rows.

    The rows of a ``load`` go to a folder of its own, with the keys below it. A lake is filled by loads or directly, not both.
    """
    folder = dest if load is None else load_folder(dest, load)
    with many_writers(frame.sparkSession):
        spread_by_keys(frame, keys).write.mode("append").partitionBy(*keys).parquet(folder)


def read_lake(spark: SparkSession, dest: str, schema: T.StructType | None = None) -> DataFrame:
    """The lake with its declared schema, which also fixes the types of the keys.

    Rows of a load that has not committed are left out (see ``logsluice.streaming.loads``).
    """
    schema = schema or lake_schema()
    rows = spark.read.schema(T.StructType([*schema.fields, LOAD])).parquet(dest)
    loads = empty_if_missing(spark, lambda: spark.read.schema(LOADS).parquet(loads_folder(dest)), LOADS)
    done = loads.select(F.col(LOAD.name).alias("_done")).distinct()
    met = rows.join(done, rows[LOAD.name] == done["_done"], "left")
    return met.where(F.col(LOAD.name).isNull() | F.col("_done").isNotNull()).select(*schema.fieldNames())


def load_folder(dest: str, load: str) -> str:
    return f"{dest.rstrip('/')}/{LOAD.name}={load}"


def loads_folder(dest: str) -> str:
    return f"{dest.rstrip('/')}/_loads"


def files_folder(dest: str) -> str:
    return f"{dest.rstrip('/')}/_files"
