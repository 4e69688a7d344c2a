"""Threshold alarms on a stream, and delivery of one stream to several tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logsluice.functions.timeparts import instant
from logsluice.operators.alarms import threshold_alarm
from logsluice.session import settings
from logsluice.sources import store
from logsluice.sources.paths import empty_if_missing

# Fixed value: the audit source delivers an event within this time.
DELIVERY_DELAY = "24 hours"


def alarm_stream(points: DataFrame, ts: str = "ts", delay: str = DELIVERY_DELAY, **rule) -> DataFrame:
    """``threshold_alarm`` on a stream; a window is final once ``delay`` has passed it.

    A watermark needs TIMESTAMP, so TIMESTAMP_NTZ input is cast. Points whose window was final when they came are
    left out; ``watch_late_points`` keeps them.
    """
    timed = points.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return threshold_alarm(timed, ts, **rule)


def _marks(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}_delivered"


def fan_out(
    stream: DataFrame, sinks: Iterable[str], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Write every batch of ``stream`` to each of ``sinks``, then stop.

    A batch owns the folder of its id, so a batch that is retried replaces what it had written
    to any of the sinks. When all sinks have a batch it is marked as delivered; ``read_delivered`` shows no other, so readers
    of different sinks see the same batches.
    """
    sinks = list(sinks)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark, marks = batch.sparkSession, _marks(checkpoint)
        batch.persist()
        try:
            for sink in sinks:
                batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        finally:
            batch.unpersist()
        store.put_mark(spark, f"{marks}/{batch_id:019d}")
        for name in store.names(spark, marks):  # batches end in order, so the newest mark says it all
            if name.isdigit() and int(name) < batch_id:
                store.remove(spark, f"{marks}/{name}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_delivered(spark: SparkSession, sink: str, checkpoint: str, schema: T.StructType) -> DataFrame:
    """What ``fan_out`` has delivered to one of its sinks, of batches that all of them have."""
    done = max((int(name) for name in store.names(spark, _marks(checkpoint)) if name.isdigit()), default=-1)
    batch = T.StructField("batch_id", T.LongType())
    rows = empty_if_missing(spark, lambda: spark.read.schema(T.StructType([*schema.fields, batch])).parquet(sink), T.StructType([*schema.fields, batch]))
    return rows.where(F.col("batch_id") <= done).select(*schema.fieldNames())


def correct_alarms(
    points: DataFrame, root: str, ts: str = "ts", rule: str = "rule", value: Column | str = "value", window: str = "5 minutes",
) -> StreamingQuery:
    """Keep every window's total right in ``root``/totals whenever its points come, then stop; ``read_alarms`` reads them.

    A batch adds what it brings to the last version of the windows it touches, and writes these as new versions; no other window is
    read or written. Versions lie by the day of their window, so that a batch looks at its days only, and by
    batch, so that one that is retried replaces its own. Points without a time belong to no window.
    """
    value = F.col(value) if isinstance(value, str) else value
    path, spans = f"{root}/totals", F.window(instant(points, ts), window)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(ts).isNotNull()).groupBy(F.col(rule), spans.alias("_window")).agg(F.sum(value).alias("total"))
        new = new.select(
            rule, F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "total",
            F.date_from_unix_date(F.floor(F.unix_seconds("_window.start") / 86400).cast("int")).cast("string").alias("day"),
        ).persist()
        try:
            schema = T.StructType([*new.schema.fields, T.StructField("batch_id", T.LongType())])
            days = [r["day"] for r in new.select("day").distinct().collect()]
            there = [p for p in (f"{path}/day={day}" for day in sorted(days)) if store.exists(spark, p)]
            both = new
            if there:
                old = spark.read.schema(schema).option("basePath", path).parquet(*there).where(F.col("batch_id") < batch_id)
                keys = [rule, "window_start", "window_end", "day"]
                last = old.groupBy(*keys).agg(F.max_by("total", "batch_id").alias("total"))
                touched = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
                same = [last[k].eqNullSafe(touched[f"_{k}"]) for k in keys]
                both = new.unionByName(last.join(touched, same, "left_semi"))
            sums = both.groupBy(rule, "window_start", "window_end", "day").agg(F.sum("total").cast(new.schema["total"].dataType).alias("total"))
            versions = sums.withColumn("batch_id", F.lit(batch_id).cast("long"))
            with settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
                versions.write.mode("overwrite").partitionBy("day", "batch_id").parquet(path)
        finally:
            new.unpersist()

    query = (
        points.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_alarms(spark: SparkSession, root: str, rule: T.StructField, total: T.DataType, threshold: float = 1) -> DataFrame:
    """Windows that breach ``threshold`` by all points that have come; ``version`` is the batch that last changed one."""
    fields = [rule, T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()),
              T.StructField("total", total), T.StructField("day", T.StringType()), T.StructField("batch_id", T.LongType())]
    rows = empty_if_missing(spark, lambda: spark.read.schema(T.StructType(fields)).parquet(f"{root}/totals"), T.StructType(fields))
    last = rows.groupBy(rule.name, "window_start", "window_end").agg(
        F.max_by("total", "batch_id").alias("total"), F.max("batch_id").alias("version")
    )
    return last.where(F.col("total") >= threshold)


def watch_late_points(
    points: DataFrame, root: str, ts: str = "ts", delay: str = DELIVERY_DELAY, window: str = "5 minutes", by_window: bool = False
) -> StreamingQuery:
    """Keep what ``alarm_stream`` leaves out of the same ``points``, in ``root``/late, then stop.

    A point is late if the newest time of all batches before its own (``by_window``: the end of its window), less ``delay``, is at
    or past the end of its window. Points without a time are kept there, too. A batch that is retried replaces what it wrote; of the
    newest times two generations are kept.
    """
    at = instant(points, ts)
    end = F.window(at, window)["end"]
    newest_schema = T.StructType([T.StructField("newest", T.TimestampType())])

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], newest_schema)
        if batch_id:
            before = spark.read.schema(newest_schema).parquet(f"{root}/newest/batch_id={batch_id - 1}")
        row = before.select(F.unix_micros("newest")).first()
        seen = F.timestamp_micros(F.lit(row[0])) if row and row[0] is not None else F.lit(None).cast("timestamp")
        late = F.coalesce(F.col("_end") <= seen - F.expr(f"interval {delay}"), F.lit(False))
        batch.persist()
        try:
            # A window drops rows without a time.
            kept = batch.withColumn("_end", end).where(late).drop("_end").unionByName(batch.where(F.col(ts).isNull()))
            kept.write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
            newest = batch.select((end if by_window else at).alias("newest")).unionByName(before)
            newest.agg(F.max("newest").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{root}/newest/batch_id={batch_id}")
        finally:
            batch.unpersist()
        store.remove(spark, f"{root}/newest/batch_id={batch_id - 2}")

    query = (
        points.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
