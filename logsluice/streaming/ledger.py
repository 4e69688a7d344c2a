"""What the loads of a lake have taken and finished, kept beside its data.

``_started`` has an empty file for each load that has begun and not been closed. ``_files`` has a row for each file taken, in
a folder for each delivery day. ``_loads`` has a row for each complete load, which alone makes a load count. The rows
of a load lie in a folder of its own, so one that broke off is undone by deleting that folder.

Small files of a day, or of ``_loads``, are merged when there are more than ``MERGE_AT``: their rows are written once
more, as one file, and then the old ones go. Readers take each row once, so a merge that breaks off in between changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.session import ensure_checkpoint_dir
from logsluice.sources import store
from logsluice.sources.lake import LOAD, LOADS, files_folder, load_folder, loads_folder
from logsluice.sources.paths import empty_if_missing

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("records", T.LongType()),
        LOAD,
        T.StructField("day", T.StringType()),
    ]
)
#: Files of one folder of the ledger before they are merged.
MERGE_AT = 32


def started_folder(dest: str) -> str:
    return f"{dest.rstrip('/')}/_started"


def complete_loads(spark: SparkSession, dest: str) -> DataFrame:
    """A row for each complete load."""
    loads = empty_if_missing(spark, lambda: spark.read.schema(LOADS).parquet(loads_folder(dest)), LOADS)
    return loads.dropDuplicates([LOAD.name])


def taken_files(spark: SparkSession, dest: str, days: Iterable[str] | None = None) -> DataFrame:
    """``path, problem, records, load_id, day`` of the files that complete loads have taken, of all or of some delivery days.

    Only the folders of the days asked for are listed, however many others there are.
    """
    root = files_folder(dest)
    if days is None:
        files = empty_if_missing(spark, lambda: spark.read.schema(FILES).parquet(root), FILES)
    else:
        there = [p for p in (f"{root}/day={day}" for day in sorted(set(days))) if store.exists(spark, p)]
        if not there:
            return spark.createDataFrame([], FILES)
        files = spark.read.schema(FILES).option("basePath", root).parquet(*there)
    done = complete_loads(spark, dest).select(LOAD.name)
    return files.join(done, LOAD.name, "left_semi").select(*FILES.fieldNames()).dropDuplicates(["path", LOAD.name])


def start(spark: SparkSession, dest: str, load: str) -> None:
    store.put_mark(spark, f"{started_folder(dest)}/{load}")


def undo_broken(spark: SparkSession, dest: str) -> list[str]:
    """Delete what loads left behind that began and did not end; returns their ids.

    One load of a lake runs at a time, so whatever is still marked as begun has broken off.
    """
    begun = store.names(spark, started_folder(dest))
    if not begun:
        return []
    done = {r[0] for r in complete_loads(spark, dest).where(F.col(LOAD.name).isin(begun)).select(LOAD.name).collect()}
    broken = [load for load in begun if load not in done]
    for load in broken:
        store.remove(spark, load_folder(dest, load))
    for load in begun:
        store.remove(spark, f"{started_folder(dest)}/{load}")
    return broken


def add_files(files: DataFrame, dest: str) -> None:
    """Append rows of ``FILES``, a file for each day."""
    files.repartition("day").write.mode("append").partitionBy("day").parquet(files_folder(dest))


def finish(spark: SparkSession, dest: str, load: str, files: int, records: int) -> None:
    """The last step of a load: from here on it counts."""
    done = spark.range(1).select(
        F.lit(load).alias(LOAD.name), F.current_timestamp().alias("at"),
        F.lit(files).cast("long").alias("files"), F.lit(records).cast("long").alias("records"),
    )
    done.coalesce(1).write.mode("append").parquet(loads_folder(dest))
    store.remove(spark, f"{started_folder(dest)}/{load}")


def merge(spark: SparkSession, dest: str, days: Iterable[str]) -> None:
    """Merge the ledger's small files: those of ``days`` and of the complete loads."""
    done = complete_loads(spark, dest)
    for day in sorted(set(days)):
        kept = T.StructType([f for f in FILES.fields if f.name != "day"])
        _merge(spark, f"{files_folder(dest)}/day={day}", kept, lambda rows: (
            rows.join(done.select(LOAD.name), LOAD.name, "left_semi").select(*kept.fieldNames()).dropDuplicates(["path", LOAD.name])
        ))
    _merge(spark, loads_folder(dest), LOADS, lambda rows: rows.dropDuplicates([LOAD.name]))


def _merge(spark: SparkSession, folder: str, schema: T.StructType, kept) -> None:
    old = [f"{folder}/{name}" for name in store.names(spark, folder) if name.endswith(".parquet")]
    if len(old) <= MERGE_AT:
        return
    ensure_checkpoint_dir(spark)
    rows = kept(spark.read.schema(schema).parquet(*old)).checkpoint()
    rows.coalesce(1).write.mode("append").parquet(folder)
    for path in old:
        store.remove(spark, path)
