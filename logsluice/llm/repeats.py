"""Remove what repeats: every byte of a string of a given length that also begins earlier in the corpus.

1. Every text is cut into pieces: runs of neighbouring windows (strings of that length) with the same least hash
   of a short gram in them, the window's key. Equal windows have equal keys, so they meet where a key's pieces meet, and
   each window lies in one piece.
2. By key: of equal pieces only the earliest matters, the others repeat it whole. Keys with a single piece are done. This is
   where a repetitive corpus shrinks; what is left are the pieces around the borders of what repeats.
3. The texts of these are gathered by key, and a run-length index (``run_index``) over them marks
   the windows that begin earlier. Keys with very many different pieces are cut into windows instead, each its own key.
4. By document: the marks are joined to the text.

Tasks hold one range of keys or one block of documents, as packed arrays; nothing else is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.llm.arrow import pack_planes, text_bytes, text_slices, unpack_planes
from logsluice.llm.common import checkpointed, running_totals, tasks_for, text_or_empty
from logsluice.llm.run_index import repeated_starts
from logsluice.llm.xxh64 import xxh64

GRAM = 24
WIDE = 64
#: A key with more different pieces than this is cut into windows; an index is built over about so many bytes.
MANY_PIECES = 4096
INDEX_BYTES = 2 << 20
SLICE = 2 << 20

#: What travels: ``part`` is a shard of keys or a block of documents, the rest are packed arrays.
FIELDS = ("key", "content", "id", "pos", "n", "kind", "text", "m_id", "m_pos", "m_n")
KINDS = {"key": "<u8", "content": "<u8", "id": "<i8", "pos": "<u4", "n": "<u2", "kind": "u1", "text": "u1",
         "m_id": "<i8", "m_pos": "<u4", "m_n": "<u4"}
PACKED = "part long, " + ", ".join(f"{f} binary" for f in FIELDS)
PLAIN, INNER, TEXT, WINDOWS = 0, 1, 2, 3
HASHES = ("key", "content")

_random = np.random.default_rng(20_240_229)
_SYMBOLS = _random.integers(0, 2**64, 256, dtype=np.uint64)
_LEVELS = _random.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# -- hashes of all strings of a length


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _LEVELS[salt]
    h = (h ^ (h >> np.uint64(27))) * _LEVELS[salt + 1]
    return h ^ (h >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``GRAM`` bytes, and of the ``WIDE`` bytes, from each place of at least ``WIDE`` bytes."""
    by = {1: _SYMBOLS[data]}
    for level, size in enumerate((1, 2, 4, 8, 16, 32)):
        a = by[size]
        by[2 * size] = a[:-size] * _LEVELS[level] + a[size:]
    gram = by[16][: len(data) - GRAM + 1] * _LEVELS[8] + by[8][16 : len(data) - GRAM + 17]
    return _mixed(gram, 9), by[WIDE]


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    done, out = 1, values
    while done * 2 <= size:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (size - done)], out[size - done :]) if done < size else out


@dataclass
class Pieces:
    key: np.ndarray
    content: np.ndarray
    at: np.ndarray
    n: np.ndarray
    inner: np.ndarray


def cut(data: np.ndarray, bounds: np.ndarray, length: int) -> Pieces:
    """The pieces of texts on end: where each begins, its number of windows, its key, a hash of what it
    holds, and whether it may hold a window twice (its least gram is there twice)."""
    span = length - GRAM + 1
    if len(data) < length:
        none = np.zeros(0, np.uint64)
        return Pieces(none, none, none.astype(np.int64), none.astype(np.int64), none.astype(bool))
    gram, wide = gram_hashes(data)
    least = window_minima(gram, span)
    across = np.zeros(len(data) + 1, np.int32)
    inner_bounds = bounds[1:-1]
    np.add.at(across, np.maximum(inner_bounds - length + 1, 0), 1)
    np.add.at(across, inner_bounds, -1)
    across = np.cumsum(across)[: len(least)] > 0
    breaks = np.ones(len(least), bool)
    breaks[1:] = (least[1:] != least[:-1]) | (across[1:] != across[:-1])
    at = np.flatnonzero(breaks)
    n = np.diff(np.append(at, len(least)))
    at, n = at[~across[at]], n[~across[at]]
    parts = -(-n // span)  # a text with a short period has long runs
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, n = np.repeat(at, parts) + nth * span, np.minimum(np.repeat(n, parts) - nth * span, span)
    key = least[at]
    inner = np.zeros(len(at), bool)
    reach = np.arange(span)
    for i in range(0, len(at), 4096):
        some = slice(i, i + 4096)
        opens = gram[at[some][:, None] + reach] == key[some][:, None]
        closes = gram[(at[some] + n[some] - 1)[:, None] + reach] == key[some][:, None]
        same_place = opens.argmax(1) == closes.argmax(1) + n[some] - 1
        inner[some] = (opens.sum(1) > 1) | (closes.sum(1) > 1) | ~same_place
    end = at + n + length - 1
    content = wide[at] + n.astype(np.uint64)
    for step in range(WIDE, span + length - 1, WIDE):  # as many blocks as the longest piece has
        content = _mixed(content, 9) + wide[np.minimum(at + step, end - WIDE)]
    content = _mixed(content, 11)
    return Pieces(key, content, at, n, inner)


# -- packed arrays


def _concat(tables: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    out = {}
    for name in names:
        held = [x for x in tables.column(name).to_pylist() if x]
        parts = [np.frombuffer(x, KINDS[name]) if name in HASHES else unpack_planes(x, (KINDS[name],))[0] for x in held]
        out[name] = np.concatenate(parts) if parts else np.zeros(0, KINDS[name])
    return out


def _rows(parts: dict[int, dict[str, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(list(parts), pa.int64())}
        | {f: pa.array([_packed(f, x[f]) if f in x else None for x in parts.values()], pa.binary()) for f in FIELDS}
    )


def _packed(field: str, values: np.ndarray) -> bytes:
    """Hashes are not to be compressed; the rest is."""
    values = values.astype(KINDS[field])
    return values.tobytes() if field in HASHES else pack_planes(values)


def _deal(out: dict[int, dict], to: np.ndarray, arrays: dict[str, np.ndarray]) -> None:
    """Add to ``out`` the entries of ``arrays`` by their part."""
    order = np.argsort(to, kind="stable")
    found, first = np.unique(to[order], return_index=True)
    for part, mine in zip(found.tolist(), np.split(order, first[1:])):
        out.setdefault(part, {}).update({name: x[mine] for name, x in arrays.items()})


def _shard(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _block(ids: np.ndarray, n: int) -> np.ndarray:
    """As ``pmod(xxhash64(id), n)`` of Spark."""
    data = np.ascontiguousarray(ids.astype("<i8")).view(np.uint8)
    hashes = xxh64(data, 8 * np.arange(len(ids)), np.full(len(ids), 8))
    return hashes.view(np.int64) % n


def earliest(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by key, content, document and place, and in it which are the first of their content."""
    order = np.lexsort((e["pos"], e["id"], e["content"], e["key"]))
    key, content = e["key"][order], e["content"][order]
    first = np.ones(len(order), bool)
    first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    return order, first


def _marks(e: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {"m_id": e["id"][which], "m_pos": e["pos"][which], "m_n": e["n"][which]}


def _joined(*marks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f: np.concatenate([m[f] for m in marks]) for f in ("m_id", "m_pos", "m_n")}


# -- the steps


def _find_pieces(length: int, shards: int) -> Callable:
    """Texts to the entries of their pieces; of equal pieces of a batch the earliest, the others as marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict[str, np.ndarray]] = []
            for some in text_slices(batch, "text", SLICE):
                data, bounds = text_bytes(some.column("text"))
                ids = some.column("id").to_numpy()
                # A text longer than a slice comes alone, and its windows are taken a slice at a time.
                for start in range(0, max(1, len(data) - length + 1), SLICE) if len(ids) == 1 else [0]:
                    end = min(start + SLICE + length - 1, len(data)) if len(ids) == 1 else len(data)
                    p = cut(data[start:end], np.array([0, end - start]) if len(ids) == 1 else bounds, length)
                    at = p.at + start
                    owner = np.searchsorted(bounds, at, "right") - 1
                    found.append({"key": p.key, "content": p.content, "id": ids[owner], "pos": at - bounds[owner], "n": p.n, "kind": p.inner})
            if found:
                yield _rows(_combined({f: np.concatenate([x[f] for x in found]) for f in found[0]}, shards))

    return run


def _combined(entries: dict[str, np.ndarray], shards: int) -> dict[int, dict[str, np.ndarray]]:
    order, first = earliest(entries)
    out: dict[int, dict[str, np.ndarray]] = {}
    kept = order[first]
    _deal(out, _shard(entries["key"][kept], shards), {f: entries[f][kept] for f in ("key", "content", "id", "pos", "n", "kind")})
    marks = _marks(entries, order[~first])
    _deal(out, _block(marks["m_id"], shards), marks)
    return out


def _meet(blocks: int) -> Callable:
    """Entries of a shard of keys to marks, and to requests for the texts of pieces that must be compared."""

    def run(table: pa.Table) -> pa.Table:
        e = _concat(table, FIELDS)
        by_key = np.argsort(e["key"], kind="stable")
        key = e["key"][by_key]
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        wanted = by_key[~alone | (e["kind"][by_key] == INNER)]
        some = {f: e[f][wanted] for f in ("key", "content", "id", "pos", "n", "kind")}
        order, first = earliest(some)
        _, group, inverse = np.unique(some["key"][order], return_index=True, return_inverse=True)
        different = np.bincount(inverse, weights=first, minlength=len(group))[inverse]
        asked = first & ((different > 1) | (some["kind"][order] == INNER))
        kind = np.where(different > MANY_PIECES, WINDOWS, TEXT)
        out: dict[int, dict[str, np.ndarray]] = {}
        marks = _joined(_marks(some, order[~first]), e)
        _deal(out, _block(marks["m_id"], blocks), marks)
        pick = order[asked]
        requests = {f: some[f][pick] for f in ("key", "id", "pos", "n")} | {"kind": kind[asked]}
        _deal(out, _block(requests["id"], blocks), requests)
        return pa.Table.from_batches([_rows(out)])

    return run


def _blocks(wide: np.ndarray, at: np.ndarray, length: int, shift: int) -> np.ndarray:
    """A hash of all ``length`` bytes from each place, block by block."""
    out = wide[at]
    for step in range(WIDE, length, WIDE):
        out = _mixed(out, shift) + wide[at + min(step, length - WIDE)]
    return out


def _texts(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.concat_arrays(docs.column("text").chunks) if docs.num_rows else pa.array([], pa.string()))


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the ranges of these starts and sizes, on end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _pack_texts(blocks: int) -> Callable:
    """Texts by block, those of a batch together: compressed they are shuffled more briefly than row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text", 16 * SLICE):
                ids, (data, bounds) = some.column("id").to_numpy(), text_bytes(some.column("text"))
                order = np.argsort(_block(ids, blocks), kind="stable")
                block, first = np.unique(_block(ids, blocks)[order], return_index=True)
                size = np.diff(bounds)
                held = [
                    pack_planes(ids[mine], size[mine], data[_gather(bounds[mine], size[mine])])
                    for mine in np.split(order, first[1:])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(held, pa.binary())], ["part", "data"])

    return run


def _fetch(length: int, shards: int) -> Callable:
    """A block of documents and the requests for it, to the texts of pieces and the entries of windows."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        e = _concat(asked, FIELDS)
        out: dict[int, dict[str, np.ndarray]] = {}
        held = [unpack_planes(x, ("<i8", "<i8", "u1")) for x in docs.column("data").to_pylist()] if len(e["id"]) else []
        ids, sizes, data = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
        starts = np.cumsum(sizes) - sizes
        by_id = np.argsort(ids, kind="stable")
        begin = starts[by_id[np.searchsorted(ids[by_id], e["id"])]] + e["pos"] if len(ids) else np.zeros(0, np.int64)
        size = e["n"].astype(np.int64) + length - 1
        cut_up = e["kind"] == WINDOWS
        if cut_up.any():
            which = np.flatnonzero(cut_up)
            text = data[_gather(begin[which], size[which])]
            _, wide = gram_hashes(text)
            n = e["n"][which].astype(np.int64)
            at = _gather(np.cumsum(size[which]) - size[which], n)
            nth = _gather(np.zeros(len(n), np.int64), n)
            windows = {
                "key": _mixed(_blocks(wide, at, length, 5), 9), "content": _mixed(_blocks(wide, at, length, 7), 11), "id": np.repeat(e["id"][which], n),
                "pos": np.repeat(e["pos"][which].astype(np.int64), n) + nth, "n": np.ones(len(nth), np.int64), "kind": np.full(len(nth), PLAIN),
            }
            out = _combined(windows, shards)
        plain = np.flatnonzero(~cut_up)
        to = _shard(e["key"][plain], shards)
        rows = [_rows(out)]
        for shard in np.unique(to).tolist():
            mine = plain[to == shard]
            text = data[_gather(begin[mine], size[mine])]
            rows.append(_rows({shard: {f: e[f][mine] for f in ("key", "id", "pos", "n")} | {"kind": np.full(len(mine), TEXT), "text": text}}))
        return pa.Table.from_batches(rows)

    return run


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin and how long they are."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _index(length: int, blocks: int) -> Callable:
    """Texts of pieces, and windows, of a shard of keys, to marks."""

    def run(table: pa.Table) -> pa.Table:
        e = _concat(table, FIELDS)
        marks = [e]
        of_windows = np.flatnonzero(e["kind"] == PLAIN)
        windows = {f: e[f][of_windows] for f in ("id", "pos", "n")}
        # Only windows have contents, so these come in their order.
        windows |= {"key": e["key"][of_windows], "content": e["content"]}
        order, first = earliest(windows)
        marks.append(_marks(windows, order[~first]))
        which = np.flatnonzero(e["kind"] == TEXT)
        size = e["n"][which].astype(np.int64) + length - 1
        start = np.cumsum(size) - size
        by_key = np.argsort(e["key"][which], kind="stable")
        key = e["key"][which][by_key]
        upto = np.cumsum(size[by_key])
        last = np.searchsorted(key, key, "right")  # one past the last piece of the same key
        held = e["text"].tobytes()
        i = 0
        while i < len(by_key):
            gone = upto[i] - size[by_key[i]]
            j = max(int(np.searchsorted(upto, gone + INDEX_BYTES, "right")), i + 1)
            mine = by_key[i : last[j - 1]]
            i = last[j - 1]
            mine = mine[np.lexsort((e["pos"][which[mine]], e["id"][which[mine]]))]
            pieces = [held[start[k] : start[k] + size[k]] for k in mine.tolist()]
            at, n = _runs(repeated_starts(pieces, length))
            begins = np.cumsum(size[mine] + 1) - (size[mine] + 1)
            owner = np.searchsorted(begins, at, "right") - 1
            source = which[mine[owner]]
            marks.append({"m_id": e["id"][source], "m_pos": e["pos"][source] + (at - begins[owner]), "m_n": n})
        out: dict[int, dict[str, np.ndarray]] = {}
        every = _joined(*marks)
        _deal(out, _block(every["m_id"], blocks), every)
        return pa.Table.from_batches([_rows(out)])

    return run


def removed_bytes(bounds: np.ndarray, ids: np.ndarray, e: dict[str, np.ndarray], length: int) -> np.ndarray:
    """For all bytes of these documents: whether a mark covers them."""
    by_id = np.argsort(ids, kind="stable")
    begin = bounds[:-1][by_id[np.searchsorted(ids[by_id], e["m_id"])]] + e["m_pos"] if len(ids) else np.zeros(0, np.int64)
    change = np.zeros(bounds[-1] + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + e["m_n"] + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _finish(length: int, digest: bool) -> Callable:
    """A block of documents and its marks, to what is left of each."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        data, bounds = _texts(docs)
        ids = docs.column("id").to_numpy()
        gone = removed_bytes(bounds, ids, _concat(marks, FIELDS), length)
        n_bytes = np.diff(bounds)
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(gone))]
        begins[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(begins)])
        if not digest:  # a character goes only if all of its bytes do
            char = np.cumsum((data & 0xC0) != 0x80) - 1
            stays = np.bincount(char, weights=~gone, minlength=char[-1] + 1 if len(char) else 0) > 0
            kept, at = data[stays[char]], np.concatenate([[0], np.cumsum(stays[char])])[bounds]
        else:
            kept, at = data[~gone], np.concatenate([[0], np.cumsum(~gone)])[bounds]
        left = [kept[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        last = [hashlib.sha256(x).hexdigest() for x in left] if digest else [x.decode() for x in left]
        return pa.table({
            "id": ids, "n_bytes": n_bytes, "n_removed": np.diff(total[bounds]), "n_spans": np.diff(spans[bounds]),
            "kept": pa.array(last, pa.string()), "rest": docs.column("rest"),
        })

    return run


def _prepared(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents ``(id, text, rest)`` with ids in their order, ``rest`` being the other columns and the key.

    The id is ``key``, if each value is there once and none is null. Else documents are numbered by key (null first)
    and hash of the text; of rows equal in both one is given, and all of them come, without text, as a second table.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"), rest.alias("rest"))
    if rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return rows, None
    rows = rows.withColumn("hash", F.xxhash64("text"))
    numbers = running_totals(rows.select("id", "hash").distinct(), ["id", "hash"], [], "number")
    numbers = checkpointed(numbers.select(F.col("id").alias("i"), F.col("hash").alias("h"), F.col("number").cast("long")))
    met = rows.join(numbers, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")))
    met = met.select(F.col("number").alias("id"), "text", "rest")
    return met.dropDuplicates(["id"]), met.select("id", "rest")


def _treated(docs: DataFrame, length: int, key: str, text: str, digest: bool) -> DataFrame:
    if length < max(GRAM, WIDE):
        raise ValueError(f"strings must have at least {max(GRAM, WIDE)} bytes")
    rows, again = _prepared(docs, key, text)
    shards = tasks_for(docs)  # by size, so that a group stays as large as it is
    blocks = 2 * shards
    texts = rows.withColumn("part", F.expr(f"pmod(xxhash64(id), {blocks}L)"))
    pieces = rows.select("id", "text").mapInArrow(_find_pieces(length, shards), PACKED)
    met = checkpointed(pieces.groupBy("part").applyInArrow(_meet(blocks), PACKED))
    nothing = F.lit(None).cast("binary")
    asked = met.where(F.length("kind") > 0).withColumns({f: nothing for f in ("content", "m_id", "m_pos", "m_n")})
    marked = met.where(F.length("m_id") > 0).withColumns({f: nothing for f in FIELDS if f[:2] != "m_"})
    packed = rows.select("id", "text").mapInArrow(_pack_texts(blocks), "part long, data binary")
    fetched = packed.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_fetch(length, shards), PACKED)
    marks = marked.union(fetched.groupBy("part").applyInArrow(_index(length, blocks), PACKED))
    out = T.StructType([
        T.StructField("id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept", T.StringType()), T.StructField("rest", rows.schema["rest"].dataType),
    ])
    left = texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_finish(length, digest), out)
    return left if again is None else left.drop("rest").join(again, "id")


def repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of the bytes that stay.

    Removed is each byte of a string of ``length`` bytes that also begins earlier: in a document of smaller key, or
    in the same one at an earlier place. Strings lie within a document, are judged on the whole input and may overlap.

    Null texts count as empty; a null key comes before all others; rows with equal keys and different texts are ordered
    by the texts' hashes; rows alike in both are one document, whose result each row gets. An empty table gives no
    rows. ``key`` is a whole number; ``length`` must be 64 or more.
    """
    left = _treated(docs.select(key, text), length, key, text, digest=True)
    return left.select(F.col(f"rest.`{key}`"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def without_repeats(
    docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", size: str | None = None
) -> DataFrame:
    """``docs`` with the texts less what ``repeats`` removes, but for characters of which only some bytes would go.

    All rows stay, also those whose text becomes empty; null texts become empty. A column ``size``, if named and there, gets the
    number of characters that are left.
    """
    left = _treated(docs, length, key, text, digest=False)
    new = {text: F.col("kept"), size: F.char_length("kept").cast("long")}
    return left.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
