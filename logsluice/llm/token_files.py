"""Token ids of documents in binary files: Simple-8b words with the documents' ids and lengths.

A file is: the eight bytes ``MAGIC``; five little-endian 64-bit numbers (documents, ids, words,
ids in a block, blocks); for each document its id and its number of ids (64 bits each) and a byte that is 1 where the id is null,
filled up to eight bytes; the word at which each block begins and the number of words; the words.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections import ChainMap
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm import simple8b
from logsluice.llm.arrow import text_slices
from logsluice.llm.common import checkpointed, running_totals, shuffle_partitions, text_or_empty

MAGIC = b"S8BTOKEN"
#: Words whose ids a worker remembers, ids in one file at most, and bytes of text and words handled at a time.
REMEMBERED = 600_000
IDS_IN_FILE = 16_000_000
BYTES_AT_ONCE = 24 << 20
WORDS_IN_CALL = 100

WRITTEN = "file string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


# -- ids of texts


@dataclass(frozen=True)
class TokenizerFile:
    """A file of the tokenizers library, and what is known of how it divides a text.

    It must never join what ASCII white space divides. ``folds_case``: it lower-cases A to Z. ``tail``: a pattern of
    marks that it always cuts off from letters before them, where these still end in a letter once composed and in lower case. Both only let fewer distinct words be encoded.
    """

    path: str
    folds_case: bool = False
    tail: str | None = None


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [(t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized]
    return tokenizer, special[0] if special else None, {"": b""}


@cache
def _open_letters() -> str:
    """A pattern for the letters that normalising makes end in something else, such as a dot above, which marks would join."""
    def form(letter: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFC", letter).lower())

    letters = map(chr, (c for c in range(0x30000) if not 0xD800 <= c < 0xE000))
    return "[" + "".join(x for x in letters if unicodedata.category(x)[0] == "L" and unicodedata.category(form(x)[-1])[0] != "L") + "]$"


def _encode_words(path: str, words: list[str]) -> list[bytes]:
    """Ids of each word as 32-bit numbers.

    A special token is found before anything else in a text, and nothing joins across it; so many words
    are encoded in one call with one between them, and the ids parted again at its id.
    """
    tokenizer, special, _ = _tokenizer(path)
    if special is None:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    mark, mark_id = special
    groups = [words[i : i + WORDS_IN_CALL] for i in range(0, len(words), WORDS_IN_CALL)]
    out: list[bytes] = []
    for group, coded in zip(groups, tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)):
        ids = np.array(coded.ids, np.uint32)
        cuts = (4 * np.flatnonzero(ids == mark_id)).tolist()
        if len(cuts) == len(group) - 1:
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)])]
        else:  # a word holds the token itself
            out += [array("I", tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in group]
    return out


def _ids_of_words(path: str, words: list[str]) -> Mapping[str, bytes]:
    """Ids of each word as 32-bit numbers; a worker remembers those of the words it met first."""
    known = _tokenizer(path)[2]
    new = [w for w in dict.fromkeys(words) if w not in known]
    found = dict(zip(new, _encode_words(path, new)))
    if len(known) < REMEMBERED:
        known.update(found)
        return known
    return ChainMap(found, known)


def encode_texts(tokenizer: TokenizerFile, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of these texts on end, and their number in each text; each distinct word is encoded once."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    if not len(words.flatten()):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    coded = words.flatten().dictionary_encode()
    stems, tails = coded.dictionary, pa.nulls(len(coded.dictionary), pa.large_string())
    if tokenizer.folds_case:  # but for what may name a special token, which is told by case
        stems = pc.if_else(pc.match_substring(stems, "<"), stems, pc.ascii_lower(stems))
    if tokenizer.tail:
        cut = pc.extract_regex(stems, rf"^(?P<stem>\p{{L}}+)(?P<tail>{tokenizer.tail})$")
        closed = pc.invert(pc.match_substring_regex(pc.fill_null(pc.struct_field(cut, "stem"), ""), _open_letters()))
        cut = pc.if_else(closed, cut, pa.scalar(None, cut.type))
        stems, tails = pc.coalesce(pc.struct_field(cut, "stem"), stems), pc.struct_field(cut, "tail")
    tails = tails.dictionary_encode()
    stems, marks, mark = stems.to_pylist(), tails.dictionary.to_pylist(), pc.fill_null(tails.indices, -1).to_pylist()
    ids = _ids_of_words(tokenizer.path, stems + marks)
    ends = [ids[m] for m in marks]
    each = [ids[word] if m < 0 else ids[word] + ends[m] for word, m in zip(stems, mark)]
    length = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), np.uint32)
    first = np.cumsum(length) - length
    which = coded.indices.to_numpy()
    sizes = length[which]
    ends = np.cumsum(sizes)
    out = flat[np.repeat(first[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
    bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()]
    return out, np.diff(bounds)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each document."""
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


# -- files


def pack(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    step = simple8b.BLOCK * 256
    words, offsets = [], [np.zeros(1, np.int64)]
    for i in range(0, len(ids), step):
        more, at = simple8b.encode(ids[i : i + step])
        words.append(more)
        offsets.append(at[1:] + offsets[-1][-1])
    offsets = np.concatenate(offsets)
    head = np.array([len(doc_ids), len(ids), offsets[-1], simple8b.BLOCK, len(offsets) - 1], "<i8")
    parts = [head, doc_ids.astype("<i8"), lengths.astype("<i8"), null.astype(np.uint8), np.zeros(-len(null) % 8, np.uint8)]
    return MAGIC + b"".join(x.tobytes() for x in [*parts, offsets.astype("<i8"), *(w.astype("<u8") for w in words)])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, where they are null, lengths, and all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    n_docs, n_ids, n_words, block, n_blocks = np.frombuffer(data, "<i8", 5, 8)
    at = 48

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, lengths, null = take("<i8", n_docs), take("<i8", n_docs), take("u1", n_docs).astype(bool)
    at += -n_docs % 8
    offsets, words = take("<i8", n_blocks + 1), take("<u8", n_words)
    step = 256
    ids = [
        simple8b.decode(words, offsets[i : i + step + 1], min(n_ids - i * block, step * block), block).astype(np.uint32)
        for i in range(0, n_blocks, step)
    ]
    return doc_ids, null, lengths, np.concatenate([np.zeros(0, np.uint32), *ids])


def _put(folder: str, name: str, data: bytes, attempt: str) -> str:
    """Write a file under a name of this attempt, then give it its own; a repeated task puts the same there."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/_{name}-{attempt}") as out:
        out.write(data)
    if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:  # some stores don't move onto a file
        store.delete_file(f"{root}/{name}")
    store.move(f"{root}/_{name}-{attempt}", f"{root}/{name}")
    return f"{folder}/{name}"


def _get(file: str) -> bytes:
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_stream(path) as f:
        return f.read()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: TokenizerFile, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts and write the ids to files below ``folder``, in ascending order of ``key``.

    ``key`` must be a whole number; executors must be able to read the tokenizer's file. ``end_id``
    follows each document. The rows returned (one for each file: ``file``, ``n_docs``,
    ``n_ids``) are written before this returns; file names sort in the order of the documents.

    Documents are dealt out by ranges of their keys, so a task holds one range, and cuts
    it into files of bounded size. Null keys come first; equal keys stay in the order read;
    null and empty texts have the end id alone; an empty table gives no files. Columns other than ``key`` and ``text`` don't
    matter, whatever their names. A very long text is encoded as a whole and fills a file alone if it has more ids than one takes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        attempt, number = str(task.taskAttemptId()), 0
        kept: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays([k for k, _, _ in kept])
            lengths, ids = np.concatenate([x for _, x, _ in kept]), np.concatenate([x for _, _, x in kept])
            null = keys.is_null().to_numpy(zero_copy_only=False)
            data = pack(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), null, lengths, ids)
            file = _put(folder, f"part-{task.partitionId():08d}-{number:05d}.s8b", data, attempt)
            return pa.RecordBatch.from_pydict({"file": [file], "n_docs": [len(keys)], "n_ids": [len(ids)]})

        for batch in batches:
            for some in text_slices(batch, "text", BYTES_AT_ONCE):
                ids, lengths = with_end(*encode_texts(tokenizer, some.column(1)), end_id)
                kept.append((some.column(0).cast(pa.int64()), lengths, ids))
                held += len(ids)
                if held >= IDS_IN_FILE:
                    yield flush()
                    kept, held, number = [], 0, number + 1
        if kept:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    ranges = (
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "key", "_tie")
        .sortWithinPartitions("key", "_tie")
    )
    return checkpointed(ranges.select("key", "text").mapInArrow(write, WRITTEN))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of these files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    ``start`` is the number of ids of all documents before it, ``ids_crc32`` the unsigned CRC-32 of its
    ids as little-endian unsigned 32-bit numbers. Each file is one piece of work, and held as a whole. Null and repeated ids come
    back as they were written; no files give no rows; columns of ``files`` other than ``file`` and ``n_ids`` don't matter.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, null, lengths, ids = unpack(_get(file))
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=null), pa.array(before + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = running_totals(files.select("file", "n_ids"), ["file"], ["n_ids"])
    spread = placed.select("file", F.col("n_ids_before").cast("long")).repartition(shuffle_partitions(files.sparkSession), "file")
    return spread.mapInArrow(read, READ)
