"""Alignment of two tokenizers' ids over the same texts, and how often ids are linked over a whole corpus.

Both tokenizers cut the same bytes. Where a token of each ends, the texts part into groups: the cumulative ends of either side
are the keys of a dictionary from end to index, the keys that both have are sorted, and they slice both lists of
ids. Within a slice, tokens whose bytes overlap are linked.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.llm.arrow import pack_planes, text_slices, unpack_planes
from logsluice.llm.common import checkpointed

#: Bytes of text handled at a time, and parts of texts that a worker remembers.
BYTES_IN_CALL = 256 << 10
REMEMBERED = 250_000
#: Links whose counts are asked for together.
LINKS_IN_SLICE = 1_000_000

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")

COLUMNS = ("a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b")
ALIGNED = ", ".join(f"{c} array<int>" for c in COLUMNS) + ", groups string"


@dataclass(frozen=True)
class Tokenizers:
    """Paths of a byte-level file of the tokenizers library (A) and of a sentencepiece model with byte fallback (B).

    A gets a space before the text, B adds one itself. Special tokens are plain text to both.
    """

    a: str
    b: str


@cache
def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and others, in order, as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@cache
def _load(files: Tokenizers):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files.a)
    a.encode_special_tokens = True
    letters = _bytes_of_letters()
    a_bytes = [
        bytes(letters[x] for x in entry) if all(x in letters for x in entry) else entry.encode()
        for entry in (a.id_to_token(i) or "" for i in range(a.get_vocab_size()))
    ]
    b = sentencepiece.SentencePieceProcessor(model_file=files.b)
    b_bytes = [
        bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()
        for piece in map(b.id_to_piece, range(b.get_piece_size()))
    ]
    a_size, b_size = (np.fromiter(map(len, x), np.int64) for x in (a_bytes, b_bytes))
    return a, b, a_bytes, b_bytes, a_size, b_size


def parts_of(text: str) -> list[str]:
    """A text cut before single spaces between other characters; that space is left out.

    Both tokenizers begin a token there, and both are given a space before each part.
    """
    return _BETWEEN.split(text) if text else []


def align_ids(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the bytes of each token on either side: the groups' ends in both lists, and the links as pairs of places."""
    ends_a = dict(zip(np.cumsum(a_sizes).tolist(), count(1)))
    ends_b = dict(zip(np.cumsum(b_sizes).tolist(), count(1)))
    common = sorted(ends_a.keys() & ends_b.keys())
    a_ends, b_ends = (np.fromiter(map(ends.__getitem__, common), np.int64, len(common)) for ends in (ends_a, ends_b))
    # Slices of one token on a side link it with each of the other's; a slice of m and n tokens has m + n - 1 links.
    m, n = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    links = m + n - 1
    first = np.cumsum(links) - links
    step = np.arange(links.sum()) - np.repeat(first, links)
    link_a = np.repeat(a_ends - m, links) + np.where(np.repeat(n == 1, links), step, 0)
    link_b = np.repeat(b_ends - n, links) + np.where(np.repeat(m == 1, links), step, 0)
    for k in np.flatnonzero((m > 1) & (n > 1)).tolist():
        i, j, at = int(a_ends[k] - m[k]), int(b_ends[k] - n[k]), int(first[k])
        left = a_sizes[i] - b_sizes[j]
        for at in range(at + 1, at + int(links[k])):  # no ends meet within a slice, so one side is always ahead
            if left < 0:
                i += 1
                left += a_sizes[i]
            else:
                j += 1
                left -= b_sizes[j]
            link_a[at], link_b[at] = i, j
    return a_ends, b_ends, link_a, link_b


class _Parts:
    """Alignments of the parts of texts that a worker has met: ids, ends and links on end, and where each part's begin."""

    def __init__(self, files: Tokenizers) -> None:
        self.files, self.place = files, {}
        self.unlike: set[int] = set()
        self.values = {c: array("i") for c in COLUMNS}
        self.groups: list[str] = []
        self.starts = {c: array("q", [0]) for c in ("a_ids", "b_ids", "a_ends", "link_a")}

    def learn(self, parts: list[str]) -> None:
        """Encode and align some new parts, as one text that has them on end; one with white space at its ends goes alone.

        A part's tokens end where it ends. Where the bytes of the tokens differ from the text's, halves are tried, down to the part that it lies in.
        """
        a, b, a_bytes, b_bytes, a_size, b_size = _load(self.files)
        text = " ".join(parts)
        whole = (" " + text).encode()
        in_a, in_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(map(a_bytes.__getitem__, in_a)) != whole or b"".join(map(b_bytes.__getitem__, in_b)) != whole:
            if len(parts) > 1:
                self.learn(parts[: len(parts) // 2])
                self.learn(parts[len(parts) // 2 :])
            else:
                self.unlike.add(len(self.place))
                self._add(parts, [np.zeros(0, np.int64)] * 6, dict.fromkeys(self.starts, np.zeros(1, np.int64)), [""])
            return
        a_ids, b_ids = np.array(in_a, np.int64), np.array(in_b, np.int64)
        a_sizes, b_sizes = a_size[a_ids], b_size[b_ids]
        a_ends, b_ends, link_a, link_b = align_ids(a_sizes, b_sizes)
        sizes = [len(p) for p in parts] if text.isascii() else [len(p.encode()) for p in parts]
        ends = np.cumsum(np.array(sizes, np.int64) + 1)
        n_a, n_b = (np.searchsorted(np.cumsum(x), ends) + 1 for x in (a_sizes, b_sizes))
        groups = np.searchsorted(a_ends, n_a) + 1
        links = n_a + n_b - groups  # a slice of m and n ids has m + n - 1

        def own(values: np.ndarray, before: np.ndarray, of: np.ndarray) -> np.ndarray:
            return values - np.repeat(before - np.diff(before, prepend=0), np.diff(of, prepend=0))

        values = [a_ids, b_ids, own(a_ends, n_a, groups), own(b_ends, n_b, groups), own(link_a, n_a, links), own(link_b, n_b, links)]
        texts = groups_text(a_ids, b_ids, a_ends, b_ends, groups).split("\n")
        self._add(parts, values, {"a_ids": n_a, "b_ids": n_b, "a_ends": groups, "link_a": links}, texts)

    def _add(self, parts: list[str], values: list[np.ndarray], upto: dict[str, np.ndarray], groups: list[str]) -> None:
        self.groups += groups
        for name, new in zip(COLUMNS, values):
            self.values[name].frombytes(new.astype(np.int32).tobytes())
        for name, new in upto.items():
            starts = self.starts[name]
            starts.frombytes((new + starts[-1]).astype(np.int64).tobytes())
        for part in parts:
            self.place[part] = len(self.place)

    def of_texts(self, texts: Sequence[str]) -> list[pa.Array]:
        """The columns of an alignment for each text, put together from its parts."""
        cut = [parts_of(t) for t in texts]
        if len(self.place) > REMEMBERED:
            self.__init__(self.files)
        new, size = [], 0
        for part in dict.fromkeys(chain.from_iterable(cut)):
            if part in self.place:
                continue
            if part != part.strip():  # white space at its ends would meet the space between parts
                self.learn([part])
            else:
                new.append(part)
                size += len(part) + 1
                if size > BYTES_IN_CALL:
                    self.learn(new)
                    new, size = [], 0
        if new:
            self.learn(new)
        codes = [list(map(self.place.__getitem__, some)) for some in cut]
        if self.unlike:
            codes = [[] if not self.unlike.isdisjoint(some) else some for some in codes]
        code = np.fromiter(chain.from_iterable(codes), np.int64)
        bounds = np.cumsum([0, *map(len, codes)])
        ids = {c: self._gather(c, c, code) for c in ("a_ids", "b_ids")}
        before = {}  # ids of the same text before each part
        for c, (_, n) in ids.items():
            upto = np.cumsum(n) - n
            before[c] = upto - np.repeat(np.append(upto, 0)[np.minimum(bounds[:-1], len(upto))], np.diff(bounds))
        out = []
        for name, of, side in zip(COLUMNS, ("a_ids", "b_ids", "a_ends", "a_ends", "link_a", "link_a"), ("a_ids", "b_ids") * 3):
            values, n = ids[name] if name in ids else self._gather(name, of, code)
            if name not in ids:
                values = values + np.repeat(before[side], n)
            offsets = np.append(0, np.cumsum(n))[bounds]
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32))))
        out.append(pa.array([";".join(map(self.groups.__getitem__, some)) for some in codes], pa.string()))
        return out

    def _gather(self, name: str, of: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of these parts on end, and how many each has."""
        starts = np.frombuffer(self.starts[of], np.int64)
        n = starts[code + 1] - starts[code]
        at = np.cumsum(n) - n
        values = np.frombuffer(self.values[name], np.int32) if len(self.values[name]) else np.zeros(0, np.int32)
        return values[np.repeat(starts[code] - at, n) + np.arange(n.sum())], n


@cache
def _parts_met(files: Tokenizers) -> _Parts:
    return _Parts(files)


@cache
def _spelt(n: int, mark: str) -> np.ndarray:
    return np.array([f"{k}{mark}" for k in range(n)], object)


def groups_text(
    a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, texts: np.ndarray | None = None
) -> str:
    """Groups as ``a1,a2|b1;a3|b2``; where ``texts`` (numbers of groups up to the end of each) end, a line ends instead."""
    if not len(a_ends):
        return ""
    m, n = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    # Ids of a stand before those of b in each group; the last of either in a group has another mark behind it.
    pieces = np.empty(len(a_ids) + len(b_ids), object)
    for ids, ends, before, between, last in ((a_ids, a_ends, np.repeat(b_ends - n, m), ",", "|"), (b_ids, b_ends, np.repeat(a_ends, n), ",", ";")):
        size = 1 << int(ids.max()).bit_length()
        words = _spelt(size, between)[ids]
        words[ends - 1] = _spelt(size, last)[ids[ends - 1]]
        pieces[np.arange(len(ids)) + before] = words
    if texts is not None:
        pieces[(a_ends + b_ends - 1)[texts - 1]] = _spelt(size, "\n")[b_ids[b_ends[texts - 1] - 1]]
    return "".join(pieces.tolist())[:-1]


def _with_columns(schema: T.StructType, more: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def _work(files: Tokenizers, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments of the texts in the last column, in place of it."""
    parts = _parts_met(files)
    for batch in batches:
        for some in text_slices(batch, "_text", 2 * BYTES_IN_CALL):
            arrays = parts.of_texts(pc.fill_null(some.column("_text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], *arrays], names=names)


def _rows(docs: DataFrame, carry: Sequence[str], text: str) -> tuple[DataFrame, T.StructType]:
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("_text"))
    return rows, T.StructType(rows.schema.fields[:-1])


def align(docs: DataFrame, files: Tokenizers, carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``carry`` of each row and its alignment; executors must be able to read both files.

    ``a_ids`` and ``b_ids`` are the text's ids; group k takes those from ``a_ends[k - 1]`` to ``a_ends[k]`` and
    likewise of b; the places ``link_a[k]`` and ``link_b[k]`` name tokens whose bytes overlap; ``groups`` has the ids of all
    groups as text (see ``groups_text``).

    Null and empty texts, and those whose bytes either tokenizer changes, have empty arrays. Rows are handled by themselves, repeated ones
    too, in the stage that reads them, about ``BYTES_IN_CALL`` bytes at a time; a longer text takes memory for its ids. An
    empty table gives no rows; other columns don't matter, but carried ones must not be called like those added.
    """
    rows, carried = _rows(docs, carry, text)
    schema = _with_columns(carried, ALIGNED)
    names = schema.fieldNames()
    return rows.mapInArrow(lambda batches: _work(files, names, batches), schema)


# -- counts over the corpus


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _slice(rows: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    """One row: carried columns of some rows, their links packed, and the different links with the rows that have each.

    Of a row's links each different one is kept once with how often it occurs, as a place in the slice's sorted links.
    """
    table = pa.Table.from_batches(rows).combine_chunks()
    lists = {c: table.column(c).combine_chunks() for c in ("a_ids", "b_ids", "link_a", "link_b")}
    n_rows = table.num_rows

    def sizes(c: str) -> np.ndarray:
        return pc.list_value_length(lists[c]).to_numpy(zero_copy_only=False).astype(np.int64)

    def values(c: str) -> np.ndarray:
        return lists[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    links = sizes("link_a")
    row = np.repeat(np.arange(n_rows), links)
    first = {c: np.cumsum(sizes(c)) - sizes(c) for c in ("a_ids", "b_ids")}
    a = values("a_ids")[values("link_a") + first["a_ids"][row]]
    b = values("b_ids")[values("link_b") + first["b_ids"][row]]
    order = np.argsort(pairs := (a << 31) | b, kind="stable")  # rows stay in order within a link
    pairs, row = pairs[order], row[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(pairs)))
    pairs, row = pairs[starts], row[starts]
    distinct, place, count = np.unique(pairs, return_inverse=True, return_counts=True)
    by_row = np.argsort(row, kind="stable")
    place, times = place[by_row], times[by_row]
    per_row = np.bincount(row, minlength=n_rows)
    steps = np.diff(place, prepend=0)  # places rise within a row
    heads = np.cumsum(per_row) - per_row
    at = heads[per_row > 0]
    steps[at] = place[at]
    packed = pack_planes(steps.astype(np.uint32), times.astype(np.uint32), per_row.astype(np.uint32))
    carried = table.drop_columns([*COLUMNS, "groups"]).combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([_ipc(carried)]), pa.array([packed]),
         pa.array([distinct], pa.list_(pa.int64())), pa.array([count.astype(np.int32)], pa.list_(pa.int32()))],
        names=["slice", "carried", "packed", "pairs", "counts"],
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += len(batch.column("link_a").flatten())
        if held >= LINKS_IN_SLICE:
            yield _slice(kept, number)
            kept, held, number = [], 0, number + 1
    if kept:
        yield _slice(kept, number)


def link_counts(
    docs: DataFrame, files: Tokenizers, carry: Sequence[str] = ("doc_id",), text: str = "text",
    also: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, added: str = "",
) -> DataFrame:
    """The columns ``carry`` of each row with ``n_best`` and ``count_sum`` of its links.

    The count of a pair of ids is the number of rows of the whole table in which it is linked. ``count_sum`` adds up
    the counts of a row's links; ``n_best`` is how many of them have the highest count of their id of a, ties included. ``also`` may
    derive more columns (``added``, as DDL) from batches of what ``align`` gives; it is called where they are made, so
    that alignments don't leave their task. Odd rows are handled as by ``align``; those without links get zeros; repeated rows count each.

    Rows are packed in slices of bounded size. A slice's different links are counted and joined as rows, combined
    before the shuffle, so that a link in every text is one row a slice; only the highest count of each id of a, of which there are as many as the
    vocabulary has entries, is broadcast. The answers meet the slice that asked, and no other.
    """
    rows, carried = _rows(docs, carry, text)
    names = [*carried.fieldNames(), *COLUMNS, "groups"]
    if added:
        carried = _with_columns(carried, added)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = _work(files, names, batches)
        return _slices(map(also, aligned) if also else aligned)

    slices = checkpointed(rows.mapInArrow(pack, "slice long, carried binary, packed binary, pairs array<long>, counts array<int>"))
    asked = slices.select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x")).select(
        "slice", "at", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")
    )
    totals = checkpointed(asked.groupBy("pair").agg(F.sum("n").alias("total")))
    a_id = F.shiftright("pair", 31)
    highest = totals.groupBy(a_id.alias("a")).agg(F.max("total").alias("highest"))
    answers = totals.join(F.broadcast(highest), a_id == F.col("a")).select(
        "pair", (F.col("total") * 2 + (F.col("total") == F.col("highest")).cast("long")).alias("answer")
    )
    answered = asked.select("slice", "at", "pair").join(answers, "pair").groupBy("slice").agg(
        F.array_sort(F.collect_list(F.struct("at", "answer"))).alias("found")
    )
    whole = slices.select("slice", "carried", "packed").join(
        answered.select("slice", F.col("found.answer").alias("answers")), "slice", "left"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                with pa.ipc.open_stream(batch.column("carried")[k].as_buffer()) as stream:
                    rows = stream.read_next_batch()
                steps, times, per_row = (x.astype(np.int64) for x in unpack_planes(batch.column("packed")[k].as_py(), ("<u4", "<u4", "<u4")))
                scalar = batch.column("answers")[k]
                answers = scalar.values.to_numpy(zero_copy_only=False) if scalar.is_valid else np.zeros(0, np.int64)
                heads = np.cumsum(per_row) - per_row
                upto = np.cumsum(steps)
                before = np.repeat(np.append(0, upto)[heads], per_row)
                mine = answers[upto - before] if len(steps) else steps
                totals = {"n_best": times * (mine & 1), "count_sum": times * (mine >> 1)}
                sums = []
                for values in totals.values():
                    run = np.append(0, np.cumsum(values))
                    sums.append(pa.array(run[heads + per_row] - run[heads], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *sums], names=[*rows.schema.names, *totals])

    return whole.select("carried", "packed", "answers").mapInArrow(finish, _with_columns(carried, "n_best long, count_sum long"))
