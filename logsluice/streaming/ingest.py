"""Incremental loads: every log file once, into event-time partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from logsluice.schemas import LAKE_KEYS
from logsluice.session import many_writers
from logsluice.sources.lake import spread_by_keys


def ingest(
    rows: DataFrame, dest: str, keys: Sequence[str] = LAKE_KEYS, **options: str
) -> StreamingQuery:
    """Load what is new in the stream ``rows`` into the lake at ``dest``, then stop.

    The checkpoint lives in the lake, so all loads of one lake share the list of files seen,
    whatever part of the source each one looks at, and a rerun adds nothing. The file sink
    commits a batch as a whole; readers see it through the sink's own log. Late rows go to the
    partition of their event time, since nothing here drops them. One load per lake at a time.
    """
    writer = (
        spread_by_keys(rows, keys)
        .writeStream.format("parquet")
        .partitionBy(*keys)
        .option("path", dest)
        .option("checkpointLocation", f"{dest.rstrip('/')}/_checkpoint")
        .options(**options)
        .trigger(availableNow=True)
    )
    with many_writers(rows.sparkSession):
        query = writer.start()
        query.awaitTermination()
    return query
