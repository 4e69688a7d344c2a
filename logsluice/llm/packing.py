"""Best-fit packing of documents into sequences, under conflicts of source and duplicate cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import n_words, running_totals, text_or_empty

CAPACITY = 2048
#: Documents that are packed together, as one piece of work.
GROUP = 8192

PACKED = "key long, piece long, start long, n_words long, bin long, offset long"
BIN_BITS = 32


class Bins:
    """Open bins in ascending order of what still fits in, with bitmaps of the sources and clusters in them."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least = capacity, least
        self.n, self.made = 0, 0
        self.rows = np.zeros((64, 4), np.uint64)  # residual, sources, clusters, bin

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Place an item; gives its bin and offset.

        The search begins at the first bin with room enough and goes on to its successors until one has neither the
        source nor the cluster: the tightest that is compatible. Without one a bin is opened.
        """
        rows, n = self.rows, self.n
        item = np.array([source, cluster], np.uint64)
        place = int(np.searchsorted(rows[:n, 0], length))
        step = 32
        while place < n:
            free = ~(rows[place : min(place + step, n), 1:3] & item).any(axis=1)
            if free.any():
                place += int(free.argmax())
                break
            place, step = place + step, step * 4
        if place < n:
            row = rows[place].copy()
            offset = self.capacity - int(row[0])
            row[0] -= np.uint64(length)
            self._close(place)
        else:
            row, offset = np.array([self.capacity - length, 0, 0, self.made], np.uint64), 0
            self.made += 1
        row[1:3] |= item
        if row[0] >= self.least:
            self._open(row)
        return int(row[3]), offset

    def _close(self, place: int) -> None:
        self.rows[place : self.n - 1] = self.rows[place + 1 : self.n].copy()
        self.n -= 1

    def _open(self, row: np.ndarray) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        place = int(np.searchsorted(self.rows[: self.n, 0], row[0]))
        self.rows[place + 1 : self.n + 1] = self.rows[place : self.n].copy()
        self.rows[place] = row
        self.n += 1


def _bits(codes: np.ndarray, shared_only: bool) -> np.ndarray:
    """A bit of 64 for each distinct value; none for values that occur once, if so wanted, and for nulls (-1)."""
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    named = (codes != -1) & ((counts[inverse] > 1) | (not shared_only))
    order = np.cumsum(np.bincount(inverse, weights=named) > 0) - 1
    return np.where(named, np.uint64(1) << (order[inverse] % 64).astype(np.uint64), np.uint64(0))


def pack_group(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """``(row, piece, start, n, bin, offset)`` of each piece of these rows, which share no bin with others.

    A row longer than a bin is cut into full pieces, each a bin by itself, and the rest. The rests go longest first, equal
    ones in the order given.
    """
    full, rest = sizes // capacity, sizes % capacity
    out, made = [], 0
    for row in np.flatnonzero(full).tolist():
        for piece in range(int(full[row])):
            out.append((row, piece, piece * capacity, capacity, made, 0))
            made += 1
    some = rest[rest > 0]
    bins = Bins(capacity, int(some.min()) if len(some) else 1)
    source_bits, cluster_bits = _bits(sources, False), _bits(clusters, True)
    for row in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[row])
        if not n:
            break
        number, offset = bins.put(n, source_bits[row], cluster_bits[row])
        out.append((row, int(full[row]), int(full[row]) * capacity, n, made + number, offset))
    return out


def pack(
    docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source",
    cluster: str | None = None, spread_sources: bool = True,
) -> DataFrame:
    """Pack the words of all documents into bins of ``capacity``: ``doc_id, piece, start, n_words, bin, offset``.

    One row for each piece: the words from ``start`` on, ``n_words`` of them, lie in ``bin`` from ``offset`` on. Every word
    of the corpus lies in one bin. A bin holds at most one piece of each duplicate cluster (column ``cluster``; by
    default texts that are equal) and, with ``spread_sources``, of each source. Bitmaps have 64 bits by
    group, so two values may share a bit: that may keep a pair apart without need, and never lets a conflict pass.

    Documents in order of key are dealt in turn to groups of at most ``GROUP``, packed each by itself; so no source or cluster
    makes a group larger. A null source or cluster conflicts with nothing; repeated rows are one cluster;
    documents without words (null texts too) get one piece of no words with null ``bin``; an
    empty table gives no rows. Other columns are not looked at.
    """
    by = F.xxhash64(text_or_empty(text)) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster))
    rows = docs.select(
        F.col(key).cast("long").alias("key"), n_words(text).alias("size"), by.alias("cluster"),
        F.when(F.col(source).isNotNull(), F.xxhash64(source)).alias("source"),
    )
    indexed = running_totals(rows, ["key", "cluster"], [], "_index")
    groups = max(1, -(-docs.count() // GROUP))

    def run(table: pa.Table) -> pa.Table:
        code = {c: table.column(c).fill_null(-1).to_numpy() for c in ("source", "cluster")}
        if not spread_sources:
            code["source"] = np.full(table.num_rows, -1)
        order = np.argsort(table.column("_index").to_numpy())
        sizes = table.column("size").to_numpy()[order]
        placed = pack_group(sizes, code["source"][order], code["cluster"][order], capacity)
        row, piece, start, n, number, offset = np.array(placed, np.int64).reshape(-1, 6).T
        keys = table.column("key").take(pa.array(order))
        group = int(table.column("_group")[0].as_py()) << BIN_BITS
        return pa.table({
            "key": keys.take(pa.array(row)), "piece": piece, "start": start, "n_words": n, "bin": group + number, "offset": offset,
        })

    dealt = indexed.withColumn("_group", F.col("_index") % groups)
    some = dealt.where("size > 0").groupBy("_group").applyInArrow(run, PACKED)
    none = dealt.where("size = 0").selectExpr("key", "0L AS piece", "0L AS start", "0L AS n_words", "CAST(NULL AS LONG) AS bin", "CAST(NULL AS LONG) AS offset")
    return some.union(none).withColumnRenamed("key", key)
