"""Reference tables kept as delimited text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.schemas import DELIMITED_PRICES, PRICE_LIST, PRICE_LIST_PREAMBLE_LINES


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType = DELIMITED_PRICES
) -> DataFrame:
    """Pipe-delimited text with one header line per file and no quoting.

    A value that does not fit its column's type reads as NULL.
    """
    return (
        spark.read.schema(schema)
        .options(sep="|", header="true", quote="", enforceSchema="true", mode="PERMISSIVE")
        .csv(path)
    )


def read_price_list(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PRICE_LIST,
    skip: int = PRICE_LIST_PREAMBLE_LINES,
) -> DataFrame:
    """Quoted CSV whose files each start with ``skip`` lines that are not data.

    Files stay splittable, and lines are read once and not shuffled: the first block of a file, which alone can hold its preamble, is
    read by one task without a gap, so that task counts lines as they come. A quoted value must not contain a line break.
    """
    lines = spark.read.text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )

    def data_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
            starts = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])))
            number = np.arange(len(file)) - np.repeat(starts, np.diff(np.append(starts, len(file))))
            if (file[0], block[0]) == last:  # the block goes on
                number[: starts[1] if len(starts) > 1 else len(file)] += seen
            last, seen = (file[-1], block[-1]), int(number[-1]) + 1
            yield batch.select(["value"]).filter(pa.array((block > 0) | (number >= skip)))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = lines.mapInArrow(data_lines, "value string")
    return rows.select(F.from_csv("value", ddl, {"sep": ","}).alias("row")).select("row.*")


def typed_prices(prices: DataFrame) -> DataFrame:
    """A typed view of the price list: the price as DOUBLE, the effective day as DATE."""
    return prices.withColumns(
        {
            "priceperunit": F.col("priceperunit").try_cast("double"),
            "effectivedate": F.col("effectivedate").try_cast("date"),
        }
    )
