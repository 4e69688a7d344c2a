"""From nested audit records to flat, typed, partition-ready rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.names import snake_case
from logsluice.functions.timeparts import utc_instant, utc_parts
from logsluice.functions.urls import before_first_dot
from logsluice.schemas import RECORD, TYPED_LEAVES, leaf_paths


def typed(column: Column, target: str | None) -> Column:
    """Convert text, giving NULL for text that does not fit instead of failing the job."""
    if target is None:
        return column
    if target == "timestamp":
        return utc_instant(column)
    return column.try_cast(target)


def as_text(frame: DataFrame, *columns: str) -> DataFrame:
    """Turn nested columns that must leave as text into JSON; text columns are kept."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    nested = (T.StructType, T.ArrayType, T.MapType)
    return frame.withColumns(
        {c: F.to_json(c) if isinstance(types[c], nested) else F.col(c).cast("string") for c in columns}
    )


def flatten(
    frame: DataFrame,
    schema: T.StructType = RECORD,
    types: Mapping[str, str] = TYPED_LEAVES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Project every leaf of ``schema`` to a snake_case column, converted where ``types`` says so.

    Columns of ``frame`` outside ``schema`` are dropped, except those in ``keep``.
    """
    leaves = [typed(F.col(p), types.get(p)).alias(snake_case(p)) for p in leaf_paths(schema)]
    return frame.select(*leaves, *keep)


def derive_keys(flat: DataFrame, account: str = "recipient_account_id", region: str = "aws_region") -> DataFrame:
    """Add the lake keys that are not columns already.

    Date keys come from event time: source folders are by delivery time, so a folder also holds
    events of the day before. Rows without a readable time keep NULL keys.
    """
    return flat.withColumns(
        {
            "account_id": F.col(account),
            "service": before_first_dot("event_source"),
            "region": F.col(region),
            **utc_parts("event_time"),
        }
    )


def to_lake_rows(records: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """Records to lake rows, with account and region taken from the record itself."""
    return derive_keys(flatten(records, schema))


def to_lake_rows_by_folder(records: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """Records to lake rows, with account and region taken from the delivery folder."""
    flat = flatten(records, schema, keep=("_account", "_region"))
    return derive_keys(flat, "_account", "_region").drop("_account", "_region")
