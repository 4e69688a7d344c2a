"""Threshold alarms over fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold_alarm(
    points: DataFrame,
    ts: str = "ts",
    rule: str = "rule",
    value: Column | str = "value",
    window: str = "5 minutes",
    threshold: float = 1,
) -> DataFrame:
    """Windows in which a rule's values sum to ``threshold`` or more.

    A window without points has no row, so missing data is not breaching. Sums are combined
    before the shuffle, so a busy rule sends one row per window and task. Works on a stream
    that carries a watermark on ``ts``.
    """
    value = F.col(value) if isinstance(value, str) else value
    return (
        points.groupBy(F.window(ts, window).alias("_window"), F.col(rule))
        .agg(F.sum(value).alias("total"))
        .where(F.col("total") >= threshold)
        .select(
            rule,
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            "total",
        )
    )
