"""The availability matrix in long form, and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_matrix(matrix: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every map column becomes rows of ``kind, service, region, available``.

    A pure row generator: the nested maps are opened where they are read, without a shuffle.
    """
    kinds = [c for c in matrix.columns if c not in keep]
    cells = F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.col(k) for k in kinds]))
    return (
        matrix.select(*keep, F.explode(cells).alias("kind", "services"))
        .select(*keep, "kind", F.explode("services").alias("service", "regions"))
        .select(*keep, "kind", "service", F.explode("regions").alias("region", "available"))
    )


def lookup(wanted: DataFrame, long_matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``available`` to each wanted row; NULL where the matrix has no cell."""
    return wanted.join(long_matrix.select(*keys, "available"), keys, "left")


def only_available(wanted: DataFrame, long_matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows whose cell is true."""
    return wanted.join(long_matrix.where("available").select(*keys), keys, "left_semi")
