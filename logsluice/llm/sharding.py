"""Contiguous shards of nearly equal bytes, from global prefix sums of the documents' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import running_totals, text_or_empty


def byte_size(text: str = "text"):
    """UTF-8 bytes of a text (null: none) plus one for its end mark."""
    return F.octet_length(text_or_empty(text)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", size: str = "size") -> DataFrame:
    """Cut ``docs``, ordered by ``key``, into ``n_shards`` contiguous shards of nearly equal ``size``.

    Adds ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (0, 1, 2... within the shard, in order of
    ``key``). A row belongs to the shard in whose equal share of all bytes its middle byte lies, so a
    shard differs from its share by at most one row. ``size`` must be a column of whole numbers.

    Null keys come first; a null size counts as 0; rows with equal keys may fall either side of a cut.
    A single row larger than a share fills its shard alone and may leave a neighbour empty. An
    empty table gives no rows. Columns of other names are kept; old columns named ``shard`` and ``slot`` are replaced.
    """
    rows = docs.drop("shard", "slot").select(
        F.col(key).alias("_key"),
        F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        F.struct("*").alias("_row"),
    )
    placed = running_totals(rows, ["_key"], ["_size"])
    total = placed.agg(F.sum("_size")).first()[0] or 1
    middle = F.col("_size_before") * 2 + F.col("_size")
    cut = placed.withColumn("_middle", middle).withColumn(
        "shard", F.least(F.expr(f"int(({n_shards}L * _middle) div {2 * total}L)"), F.lit(n_shards - 1))
    )
    firsts = cut.groupBy("shard").agg(F.min("_index").alias("_first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "_row.*", "shard", (F.col("_index") - F.col("_first")).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows below ``path``, in one folder for each shard; many tasks may write to a shard."""
    sharded.write.partitionBy("shard").parquet(path)
