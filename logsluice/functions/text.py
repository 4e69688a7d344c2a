"""String predicates and helpers, all built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Access-log entries written by load-balancer health checks.
NOISE_MARKERS = (
    "error:invalid-request",
    "error:transaction-end-before-headers",
)


def not_blank(column: Column | str) -> Column:
    """True when something is left after removing tab, LF and CR and trimming spaces.

    NULL gives NULL, so a filter drops it.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(F.translate(column, "\t\n\r", "")) != F.lit("")


def is_noise(column: Column | str, markers: tuple[str, ...] = NOISE_MARKERS) -> Column:
    """True for lines that contain any of the literal ``markers``."""
    column = F.col(column) if isinstance(column, str) else column
    return column.rlike("|".join(_literal(marker) for marker in markers))


def zero_pad(column: Column | str, width: int = 2) -> Column:
    """Left-pad with zeros; longer values are kept whole."""
    column = F.col(column) if isinstance(column, str) else column
    text = column.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def without_prefix(column: Column | str, prefix: str) -> Column:
    """The text after ``prefix``, or the text itself when it does not start with it."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.startswith(prefix), F.substring(column, len(prefix) + 1, 2**31 - 1)).otherwise(
        column
    )


def _literal(marker: str) -> str:
    return "".join(c if c.isalnum() or c in ":- _" else "\\" + c for c in marker)
