"""Failure runs on a stream of probes that may arrive out of order, delivered to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logsluice.session import settings
from logsluice.streaming.alarms import DELIVERY_DELAY, watch_late_points
from logsluice.streaming.health import STORE, failure_run_stream, k_of_n_stream


def _deliver(stream: DataFrame, root: str, name: str) -> StreamingQuery:
    """Write what the stream finishes to folders of its batches, then stop; a batch that is retried replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")

    with settings(stream.sparkSession, **{key.replace(".", "__"): value for key, value in STORE.items()}):
        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{root}/_checkpoint_{name}")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return query


def watch_failure_runs(
    probes: DataFrame, root: str, keys: list[str], order: list[str], failed: Column | str = "failed", threshold: int = 1,
    delay: str = DELIVERY_DELAY, bucket: str = "1 hour",
) -> StreamingQuery:
    """Process what is new in ``probes``, then stop; finished rows are in ``root``/runs.

    Rows that came after their slice was closed, or have no time, are in ``root``/missed/late. What is carried from one call to the
    next lies in the state store below ``root``, of which a call changes the states of the keys and slices it meets.
    """
    watch_late_points(probes, f"{root}/missed", order[0], delay, bucket, by_window=True)
    return _deliver(failure_run_stream(probes, keys, order, failed, threshold, delay, bucket), root, "runs")


def read_runs(probes: DataFrame, root: str) -> DataFrame:
    """All rows finished so far."""
    more = [T.StructField("run", T.LongType()), T.StructField("unhealthy", T.BooleanType())]
    return probes.sparkSession.read.schema(T.StructType([*probes.schema.fields, *more])).parquet(f"{root}/runs/*")


def watch_k_of_n(
    probes: DataFrame, root: str, parent: list[str], child: list[str], order: list[str], failed: Column | str = "failed",
    k: int = 2, threshold: int = 1, delay: str = DELIVERY_DELAY, bucket: str = "1 hour",
) -> StreamingQuery:
    """Process what is new in ``probes``, then stop; changes of the parents' health are in ``root``/health."""
    return _deliver(k_of_n_stream(probes, parent, child, order, failed, k, threshold, delay, bucket), root, "health")


def read_health(probes: DataFrame, root: str, parent: list[str]) -> DataFrame:
    """The last known health of each parent."""
    fields = [T.StructField("at", T.TimestampType()), T.StructField("children", T.LongType()), T.StructField("healthy_children", T.LongType()),
              T.StructField("healthy", T.BooleanType())]
    rows = probes.sparkSession.read.schema(T.StructType([*probes.select(*parent).schema.fields, *fields])).parquet(f"{root}/health/*")
    last = rows.groupBy(*parent).agg(F.max_by(F.struct(*[f.name for f in fields]), "at").alias("_last"))
    return last.select(*parent, "_last.*")
