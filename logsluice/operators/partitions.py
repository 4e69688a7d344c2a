"""Finding, comparing and reconciling table partitions as DataFrames."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.functions.paths import ACCOUNT_LAYOUT, Layout, recent_days, with_path_values


def parse_locations(locations: DataFrame, layout: Layout = ACCOUNT_LAYOUT) -> DataFrame:
    """Add the layout's key values to each ``location``."""
    return with_path_values(locations, "location", layout)


def well_formed(parsed: DataFrame, layout: Layout = ACCOUNT_LAYOUT) -> DataFrame:
    """Locations that fit the layout."""
    return parsed.where(F.col(layout.keys[0]).isNotNull())


def quarantined(parsed: DataFrame, layout: Layout = ACCOUNT_LAYOUT) -> DataFrame:
    """Locations that do not fit, kept for a look instead of being registered shifted."""
    return parsed.where(F.col(layout.keys[0]).isNull())


def candidates(
    pairs: DataFrame, as_of: date, account: str = "account", region: str = "region"
) -> DataFrame:
    """Each (account, region) pair with its today and yesterday; a row generator, not a join."""
    days = F.array(*[F.lit(d) for d in recent_days(as_of)])
    return pairs.select(account, region, F.explode(days).alias("day"))


def candidate_locations(
    pairs: DataFrame, as_of: date, root: str, layout: Layout = ACCOUNT_LAYOUT,
    account: str = "account", region: str = "region",
) -> DataFrame:
    """The folders of ``candidates`` below ``root``, with a trailing ``/``."""
    days = [layout.folder(root, F.col(account), F.col(region), d) for d in recent_days(as_of)]
    return pairs.select(F.explode(F.array(*days)).alias("location"))


def account_regions(parsed: DataFrame) -> DataFrame:
    """Accounts and the regions each of them has."""
    return parsed.select(F.col("accountid").alias("account"), "region").distinct()


def new_partitions(found: DataFrame, registered: DataFrame, on: str | list[str] = "location") -> DataFrame:
    """Found but not registered. Spark broadcasts the registry when it is small enough."""
    keys = [on] if isinstance(on, str) else on
    return found.join(registered.select(*keys), keys, "left_anti")


def reconcile(before: DataFrame, added: DataFrame, after: DataFrame, key: str = "location") -> DataFrame:
    """One row: the partitions expected, those there, and whether they agree."""
    counts = (
        before.select(F.lit("before").alias("side"), key)
        .unionByName(added.select(F.lit("added").alias("side"), key))
        .unionByName(after.select(F.lit("after").alias("side"), key))
        .distinct()
        .agg(
            F.count_if(F.col("side") != "after").alias("expected"),
            F.count_if(F.col("side") == "after").alias("actual"),
        )
    )
    return counts.withColumn("ok", F.col("expected") == F.col("actual"))
