"""Text logs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsluice.functions.text import is_noise
from logsluice.sources.following import GrowingText


def tail_text(spark: SparkSession, folder: str, filter_noise: bool = False) -> DataFrame:
    """Lines of a folder of logs as they are written, health-check noise dropped on request.

    Files may grow between and during batches, and may be rotated to other names in the folder; each whole line arrives once.
    """
    spark.dataSource.register(GrowingText)
    lines = spark.readStream.format("growing_text").load(folder)
    return lines.where(~is_noise("value")) if filter_noise else lines
