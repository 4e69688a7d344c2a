"""Reader for the availability matrix file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsluice.schemas import MATRIX


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, one column per kind, each a service -> region -> boolean map."""
    return spark.read.schema(MATRIX).options(multiLine="true", mode="FAILFAST").json(path)
