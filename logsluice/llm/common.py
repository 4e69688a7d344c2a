"""Helpers that the operators share: tables, checkpoints, checked broadcasts, global running totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsluice.session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most so many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, with their lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Tasks that ``df`` should be dealt to: those of a shuffle, or more if what it is read from has more than ``each`` bytes for one.

    The sizes are Spark's own of the tables and files read, which say how much they take there; what has none counts nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(n).stats().sizeInBytes()) for n in range(leaves.size())]
    return max(shuffle_partitions(df.sparkSession), -(-sum(size for size in sizes if size < 1 << 60) // each))


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it has few rows; else as it is.

    ``df`` should be checkpointed, as it is counted first and used again.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(column: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once for the row, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def bucket(figure: Column) -> Column:
    """Lower end of the bucket of a whole number >= 0: exact below 64, else its six leading binary digits.

    A bucket is narrower than a thirty-second of its lower end. Counts by bucket are a quantile sketch of
    bounded size (about 32 buckets for each power of two) that merges by addition.
    """
    shift = F.greatest(F.length(F.bin(figure)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", figure, shift), shift)


def running_totals(
    df: DataFrame, order: Sequence[str], values: Sequence[str], index: str = "_index"
) -> DataFrame:
    """Add ``<value>_before`` and ``index``: sums and number of all rows that come earlier in ``order``.

    Rows are dealt out by ranges of ``order``, each partition adds up its own, and the totals of
    the partitions (a row for each, so their number is bounded and they may be broadcast) are
    summed in turn. No task sees more than its range. Rows alike in all of ``order`` are told
    apart by the place they are read from, so that even they spread over partitions.
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = checkpointed(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *[F.col(c) for c in order], "_tie")
        .withColumn("_part", F.spark_partition_id())
    )
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part",
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_start_{v}") for v in values],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start_n"),
    )
    own = Window.partitionBy("_part").orderBy(*[F.col(c) for c in order], "_tie")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumns(
            {f"{v}_before": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values}
            | {index: F.row_number().over(own) - 1}
        )
        .join(F.broadcast(starts), "_part")
        .withColumns(
            {f"{v}_before": F.col(f"{v}_before") + F.col(f"_start_{v}") for v in values}
            | {index: F.col(index) + F.col("_start_n")}
        )
        .drop("_part", "_tie", "_start_n", *[f"_start_{v}" for v in values])
    )
