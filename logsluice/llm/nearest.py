"""Nearest neighbours by inner product: a join of blocks whose int8 products bound the scores."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of one of candidates, and of the tiles in which a task multiplies them.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
QUERY_TILE = 256
CANDIDATE_TILE = 2048

FOUND = "query_id long, vec_id long, score double"


@dataclass
class Quantised:
    """Vectors as ``scale * code`` with codes from -127 to 127, the length of that, and of what it lacks."""

    exact: np.ndarray
    code: np.ndarray
    scale: np.ndarray
    length: np.ndarray
    lack: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Quantised:
        most = np.abs(vectors).max(axis=1)
        scale = np.where(most / 127 > 0, most / 127, most)  # of the least numbers there are no fractions
        inside = vectors / scale[:, None]
        code = np.rint(inside).astype(np.int8)
        # Lengths are taken before scaling, where squares neither vanish nor overflow.
        length, lack = np.linalg.norm(code, axis=1), np.linalg.norm(inside - code, axis=1)
        return cls(vectors, code, scale, length * scale, lack * scale)

    def tile(self, start: int, size: int) -> Quantised:
        some = slice(start, start + size)
        return Quantised(self.exact[some], self.code[some], self.scale[some], self.length[some], self.lack[some])


def score_bounds(q: Quantised, x: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products from the codes, and how far off each may be.

    With q = q' + a and x = x' + b, q.x - q'.x' = q'.b + a.x' + a.b, and each term is at most the product of the
    lengths. A product of codes is a whole number, exact in the floats it is computed in; a margin covers their rounding.
    """
    exact = np.float32 if q.code.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (q.code.astype(exact) @ x.code.astype(exact).T).astype(np.float64)
    product *= q.scale[:, None]
    product *= x.scale[None, :]
    off = np.outer(q.length + q.lack, x.lack) + np.outer(q.lack, x.length)
    off += 1e-12 * np.outer(q.length + q.lack, x.length + x.lack)
    return product, off


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, in double precision, added up from the first component on."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def block_top(q_ids: np.ndarray, q: Quantised, x_ids: np.ndarray, x: Quantised, k: int) -> list[list[tuple[float, int]]]:
    """For each query its ``k`` nearest rows of the block, best first, as ``(-score, id)``.

    In each tile a row survives if its score may reach the ``k``-th best known so far, of the scores
    kept and of the least the tile's rows can have. Survivors are computed exactly, and their
    sorted lists merged with those kept by a heap.
    """
    best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for i in range(0, len(q_ids), QUERY_TILE):
        ids, tile = q_ids[i : i + QUERY_TILE], q.tile(i, QUERY_TILE)
        for j in range(0, len(x_ids), CANDIDATE_TILE):
            others, rows = x_ids[j : j + CANDIDATE_TILE], x.tile(j, CANDIDATE_TILE)
            near, off = score_bounds(tile, rows)
            own = ids[:, None] == others[None, :]
            least = np.where(own, -np.inf, near - off)
            known = np.array([-b[k - 1][0] if len(b) >= k else -np.inf for b in best[i : i + QUERY_TILE]])
            if least.shape[1] > k:
                known = np.maximum(known, np.partition(least, -k, axis=1)[:, -k])
            a, b = np.nonzero((near + off >= known[:, None]) & ~own)
            score = exact_scores(tile.exact[a], rows.exact[b])
            order = np.lexsort((others[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.searchsorted(a, np.arange(len(ids) + 1))
            for n in np.unique(a).tolist():
                some = slice(first[n], min(first[n + 1], first[n] + k))
                new = zip((-score[some]).tolist(), others[b[some]].tolist())
                best[i + n] = [x for x, _ in zip(heapq.merge(best[i + n], new), range(k))]
    return best


def _vectors(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    mine = table.filter(pc.equal(table.column("dim"), dim))
    flat = mine.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return mine.column("id").to_numpy(), flat.astype(np.float64).reshape(-1, dim)


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, all components there and finite, one not zero."""
    return (
        F.col(vector).isNotNull()
        & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(vector, lambda x: x != 0)
    )


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product with each query: ``query_id, rank, vec_id, score``.

    The result is exact: no row that may be among the nearest is dropped. ``rank`` counts from 1; equal scores go by the
    smaller key; rows with the query's own key are left out; a query with fewer candidates
    gets them all.

    Vectors that are null, empty or zero, or hold a null or a number that is not finite, and rows with a null key, take no
    part. Only vectors of equal length are compared. Repeated rows each count. Empty tables give no
    rows; other columns are not looked at.

    Queries and candidates are dealt out in blocks of bounded size, round robin, and each pair of blocks is one piece of
    work; so no vector, however often it occurs, makes one larger.
    """

    def rows(df: DataFrame) -> DataFrame:
        good = df.where(F.col(key).isNotNull()).where(usable(vector))
        return good.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("dim"))

    def blocks(df: DataFrame, size: int) -> int:
        return max(1, -(-df.count() // size))

    q, x = rows(queries), rows(vectors)
    n_q, n_x = blocks(queries, QUERY_BLOCK), blocks(vectors, CANDIDATE_BLOCK)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.lit(n))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        )

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for dim in pc.unique(asked.column("dim")).to_pylist():
            q_ids, q_rows = _vectors(asked, dim)
            x_ids, x_rows = _vectors(held, dim)
            found = block_top(q_ids, Quantised.of(q_rows), x_ids, Quantised.of(x_rows), k) if len(x_ids) else []
            for query, best in zip(q_ids.tolist(), found):
                out["query_id"] += [query] * len(best)
                out["vec_id"] += [b for _, b in best]
                out["score"] += [-s for s, _ in best]
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    left = dealt(q, "_q", n_q, "_x", n_x).groupBy("_q", "_x")
    right = dealt(x, "_x", n_x, "_q", n_q).groupBy("_q", "_x")
    found = left.cogroup(right).applyInArrow(compare, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
