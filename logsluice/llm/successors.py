"""Each row together with the row after it, in the order of a key, over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import checkpointed, tasks_for


def in_ranges(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Add ``_range``, 0 to ``n`` - 1: contiguous ranges of the whole-number column ``key`` with about as many rows each.

    The borders come from a quantile sketch of the keys. Rows of one key that fills several ranges, or that lies on a
    border, are spread over them by ``_place``, a number that orders rows of equal keys; so no key is too frequent.
    Null keys come first.
    """
    borders = rows.select(
        F.percentile_approx(F.coalesce(key, F.lit(-(1 << 63))), [k / n for k in range(1, n)] or [0.5], 100 * n)
    ).scalar()
    steps = F.lit([1 << k for k in reversed(range(n.bit_length()))])

    def found(before: Callable[[Column], Column]) -> Column:
        """How many borders, which are sorted, come ``before``; by halving."""
        return F.aggregate(
            steps, F.lit(0), lambda at, step: F.when(F.coalesce(before(F.get("_borders", at + step - 1)), F.lit(False)), at + step).otherwise(at)
        )

    spread = ((F.col("_above") - F.col("_below") + 1) * F.col("_place")).cast("int")
    return (
        rows.withColumn("_place", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
        .withColumn("_sought", F.coalesce(key, F.lit(-(1 << 63))))
        .withColumn("_borders", borders)
        .withColumn("_above", found(lambda b: b <= F.col("_sought")))
        .withColumn("_below", found(lambda b: b < F.col("_sought")))
        .withColumn("_range", F.least(F.col("_below") + spread, F.lit(n - 1)))
        .drop("_sought", "_borders", "_above", "_below")
    )


def with_next(
    docs: DataFrame, value: Column, use: Callable[[Column, Column], Column], key: str = "doc_id", ranges: int | None = None
) -> DataFrame:
    """``key`` and the fields of the struct ``use(own, next)``, for each row's ``value`` and that of the next row.

    The next row is the one after it in ascending order of ``key``, a whole number; after the last comes the first, so
    a single row follows itself. Null keys come first, rows of equal keys in any order. An empty table gives no rows.

    Values are shuffled once, into ranges of the key, and read in order there by a window that spills; so no
    task holds more than its range. Only the last value of a range crosses to another: those of
    all ranges, one each, are joined with the first values of the ranges after them.
    """
    n = ranges or tasks_for(docs)
    rows = docs.select(F.col(key).cast("long").alias("_key"), value.alias("_own"))
    order = Window.partitionBy("_range").orderBy(F.col("_key").asc_nulls_first(), "_place")
    led = (
        in_ranges(rows, "_key", n)
        .repartitionById(n, F.col("_range"))
        .withColumn("_next", F.lead("_own").over(order))
        .withColumn("_first", F.row_number().over(order) == 1)
    )
    done = checkpointed(
        led.select(
            "_key", "_range",
            F.when(F.col("_next").isNotNull(), use(F.col("_own"), F.col("_next"))).alias("_out"),
            F.when(F.col("_next").isNull(), F.col("_own")).alias("_last"),
            F.when(F.col("_first"), F.col("_own")).alias("_head"),
        )
    )
    by_range = Window.orderBy("_range")  # a row for each range
    heads = done.where("_head IS NOT NULL").select(
        "_head", F.row_number().over(by_range).alias("_rank"), F.lead("_range").over(by_range).alias("_later")
    )
    lasts = done.where("_last IS NOT NULL").select("_key", "_last", F.row_number().over(by_range).alias("_n"), F.lead("_range").over(by_range).alias("_later"))
    after = F.when(F.col("_later").isNull(), F.lit(1)).otherwise(F.col("_n") + 1)
    ends = lasts.select("_key", "_last", after.alias("_rank")).join(heads.select("_head", "_rank"), "_rank")
    both = done.where("_out IS NOT NULL").select("_key", "_out").unionAll(
        ends.select("_key", use(F.col("_last"), F.col("_head")).alias("_out"))
    )
    return both.select(F.col("_key").alias(key), "_out.*")
