"""Reads of globs that may match nothing yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def empty_if_missing(
    spark: SparkSession, read: Callable[[], DataFrame], schema: T.StructType
) -> DataFrame:
    """``read()``, or no rows when its path matches no file."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
