"""Runs of consecutive failures, computed without putting a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_runs(
    probes: DataFrame,
    keys: list[str],
    order: list[str],
    failed: Column | str = "failed",
    threshold: int = 1,
    carry: DataFrame | None = None,
    bucket: str = "day",
) -> DataFrame:
    """Add ``run`` (consecutive failures up to and including a row) and ``unhealthy``.

    ``order`` must be unique within a key, and begin with a time. ``carry`` gives the ``run`` each key starts with.

    A key's rows are cut into slices by ``bucket`` (what ``date_trunc`` knows, such as ``hour`` or ``day``), which changes no
    result; the interval of the probes bounds a slice. Each slice counts on its own; what crosses a
    border is one number per slice, so the rows themselves are shuffled once.
    """
    failed = F.col(failed) if isinstance(failed, str) else failed
    # As one struct, keys that are NULL equal each other wherever slices are matched.
    slice_of = F.struct(*[F.col(k) for k in keys], F.date_trunc(bucket, order[0]).alias("_bucket"))
    in_order = Window.partitionBy("_slice").orderBy(*order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (
        probes.withColumn("_failed", F.coalesce(failed, F.lit(False)))
        .withColumn("_slice", slice_of)
        .withColumn("_row", F.row_number().over(in_order))
        .withColumn("_last_ok", F.max(F.when(~F.col("_failed"), F.col("_row"))).over(so_far))
    )
    run = F.col("_row") - F.coalesce("_last_ok", F.lit(0)) + F.when(
        F.col("_last_ok").isNull(), F.coalesce("_entering", F.lit(0))
    ).otherwise(0)
    return (
        counted.join(_entering_runs(counted, keys, carry), "_slice", "left")
        .withColumn("run", run.cast("bigint"))
        .withColumn("unhealthy", F.col("run") >= threshold)
        .select(*probes.columns, "run", "unhealthy")
    )


def _entering_runs(counted: DataFrame, keys: list[str], carry: DataFrame | None) -> DataFrame:
    """The run length with which a key enters a slice, where it is not zero."""
    tails = counted.groupBy("_slice").agg(
        (F.max("_row") - F.coalesce(F.max("_last_ok"), F.lit(0))).alias("_tail"),
        F.max("_last_ok").isNotNull().alias("_reset"),
    )
    tails = tails.withColumn("_begin", F.lit(1))
    if carry is not None:
        bucket = counted.schema["_slice"].dataType["_bucket"].dataType
        start = F.struct(*[F.col(k) for k in keys], F.lit(None).cast(bucket).alias("_bucket"))
        tails = tails.unionByName(
            carry.select(start.alias("_slice"), F.col("run").alias("_tail"), F.lit(True).alias("_reset"), F.lit(0).alias("_begin"))
        )
    tails = tails.withColumn("_key", F.struct(*[F.col(f"_slice.{k}").alias(k) for k in keys]))
    slices = Window.partitionBy("_key").orderBy("_begin", "_slice._bucket")
    so_far = slices.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since_reset = (
        Window.partitionBy("_key", "_island")
        .orderBy("_begin", "_slice._bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tails.withColumn("_island", F.sum(F.col("_reset").cast("int")).over(so_far))
        .withColumn("_leaving", F.sum("_tail").over(since_reset))
        .withColumn("_entering", F.lag("_leaving").over(slices))
        .where((F.col("_begin") == 1) & (F.col("_entering") > 0))
        .select("_slice", "_entering")
    )


def last_runs(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The run each key ends with: what a later batch has to carry on from."""
    return runs.groupBy(*keys).agg(F.max_by("run", F.struct(*order)).alias("run"))
