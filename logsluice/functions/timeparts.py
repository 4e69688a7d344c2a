"""Calendar parts that do not depend on the session time zone."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_parts(column: Column | str) -> dict[str, Column]:
    """``year, month, day, hour`` (int) of a TIMESTAMP, read as UTC.

    Works from the epoch, so a session in another zone partitions the same way.
    """
    column = F.col(column) if isinstance(column, str) else column
    seconds = F.unix_seconds(column)
    date = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "hour": F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int"),
    }


def local_parts(column: Column | str) -> dict[str, Column]:
    """The same parts for a TIMESTAMP_NTZ, which carries its own wall clock."""
    return {
        "year": F.year(column),
        "month": F.month(column),
        "day": F.dayofmonth(column),
        "hour": F.hour(column),
    }


def partition_date(year: str = "year", month: str = "month", day: str = "day") -> Column:
    """The date named by three text or int partition keys; NULL when one of them is, or they name none."""
    year, month, day = (F.col(c).cast("string") for c in (year, month, day))
    return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")


def from_day(first: date, year: str = "year", month: str = "month", day: str = "day") -> Column:
    """Whether padded text keys name ``first`` or a later day: plain comparisons of each key, which a metastore can prune by."""
    keys = [(F.col(year), f"{first:%Y}"), (F.col(month), f"{first:%m}"), (F.col(day), f"{first:%d}")]
    (y, year_text), (m, month_text), (d, day_text) = keys
    same_month = (m == month_text) & (d >= day_text)
    return (y > year_text) | ((y == year_text) & ((m > month_text) | same_month))


def utc_instant(text: Column) -> Column:
    """The TIMESTAMP that ISO text names; text without a zone is UTC, whatever the session's zone is."""
    zoned = text.rlike(r":\d{2}.*(Z|[A-Za-z]|[+-]\d{1,2}(:?\d{2})?)\s*$")
    wall_clock = text.try_cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), wall_clock)
    return F.when(zoned, F.try_to_timestamp(text)).otherwise(F.timestamp_micros(micros))


def instant(frame: DataFrame, column: str) -> Column:
    """A time column as TIMESTAMP; a TIMESTAMP_NTZ is UTC, whatever the session's zone is."""
    if isinstance(frame.schema[column].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(column)))
    return F.col(column).cast("timestamp")


def time_order(frame: DataFrame, ts: str, tie: str) -> Column:
    """One number that sorts like ``(ts, tie)``, for an integer ``tie``.

    Aggregates keep a number in a hash table; for a struct they would have to sort the input.
    """
    if isinstance(frame.schema[ts].dataType, T.TimestampType):
        micros = F.unix_micros(ts)
    else:
        days = F.unix_date(F.col(ts).cast("date")).cast("bigint")
        seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
        # The second comes with six decimals.
        micros = seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    # Wide enough that a 64-bit tie never reaches the next microsecond.
    return micros.cast("decimal(18,0)") * F.lit(Decimal(2 * 10**19)) + F.col(tie)
