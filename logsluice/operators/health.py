"""Calculated health from child checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.timeparts import time_order


def latest_status(
    probes: DataFrame,
    keys: list[str],
    ts: str = "ts",
    tie: str = "probe_id",
    healthy: Column | str = "healthy",
) -> DataFrame:
    """The last known health per key, by a hash aggregate that combines before the shuffle."""
    healthy = F.col(healthy) if isinstance(healthy, str) else healthy
    newest = time_order(probes, ts, tie)
    return probes.groupBy(*keys).agg(F.max_by(healthy, newest).alias("healthy"))


def k_of_n(children: DataFrame, parent: str, k: int | Column = 2, healthy: Column | str = "healthy") -> DataFrame:
    """A parent is healthy when at least ``k`` of its children are."""
    healthy = F.col(healthy) if isinstance(healthy, str) else healthy
    return (
        children.groupBy(parent)
        .agg(F.count("*").alias("children"), F.count_if(healthy).alias("healthy_children"))
        .withColumn("healthy", F.col("healthy_children") >= k)
    )


def calculated_health(status: DataFrame, tree: DataFrame) -> DataFrame:
    """``k_of_n`` over a ``(parent, child, threshold)`` tree; a child without probes is unhealthy."""
    joined = tree.join(status, tree["child"] == status["endpoint"], "left")
    return (
        joined.groupBy("parent")
        .agg(
            F.count("*").alias("children"),
            F.count_if(F.coalesce("healthy", F.lit(False))).alias("healthy_children"),
            F.max("threshold").alias("threshold"),
        )
        .withColumn("healthy", F.col("healthy_children") >= F.col("threshold"))
    )
