"""Helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes of text, at least a row each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    size = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        gone = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, gone + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end (null: none), and where each begins, with the end of the last."""
    filled = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(filled):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64, len(filled) + 1, 8 * filled.offset)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def pack_planes(*arrays: np.ndarray) -> bytes:
    """Arrays by planes of bytes, compressed: numbers that use few of their bytes, or texts, then take little room in shuffles."""
    parts = []
    for x in arrays:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""
        body = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        parts.append(np.array([len(x), len(body)], "<i8").tobytes() + body)
    return b"".join(parts)


def unpack_planes(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of ``pack_planes``, given their types."""
    at, out = 0, []
    for kind in kinds:
        n, size = np.frombuffer(data, "<i8", 2, at).tolist()
        width = np.dtype(kind).itemsize
        raw = pa.decompress(data[at + 16 : at + 16 + size], n * width, codec="zstd", asbytes=True) if size else b""
        planes = np.frombuffer(raw, np.uint8).reshape(width, n).T if n else np.zeros((0, width), np.uint8)
        out.append(np.ascontiguousarray(planes).view(kind).reshape(-1))
        at += 16 + size
    return out
