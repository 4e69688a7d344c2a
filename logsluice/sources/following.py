"""A streaming source of text files that grow, are rotated and are cut off, line by line."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that tell one file from another, bytes read at a time, and bytes of one task.
HEAD = 256
CHUNK = 1 << 20
SPLIT = 64 << 20


@dataclass
class _Lines(InputPartition):
    """Lines that begin from byte ``start`` on and before byte ``end`` of the file that begins with ``head``."""

    name: str
    head: str
    start: int
    end: int
    first: int


class _Follower(DataSourceStreamReader):
    """Offsets are, for each file, its first bytes and the end of its last whole line.

    A file whose first bytes are the same goes on where it was left, under whatever name, so that one that was rotated is
    neither lost nor read again. A file that has become shorter, or begins otherwise, is a new one.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _store(self):
        return fs.FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = self._store()
        out = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and info.size and not info.base_name.startswith((".", "_")):
                with store.open_input_file(info.path) as file:
                    end = _last_line_end(file, info.size)
                    if end:
                        out[info.base_name] = {"head": base64.b64encode(file.read_at(min(HEAD, end), 0)).decode(), "end": end}
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        left = dict(start)
        begin = {name: left.pop(name)["end"] for name, now in end.items() if name in start and _goes_on(start[name], now)}
        for name, now in end.items():
            if name not in begin:  # rotated here from another name, or new
                old = max((k for k, was in left.items() if _goes_on(was, now)), key=lambda k: left[k]["end"], default=None)
                begin[name] = left.pop(old)["end"] if old is not None else 0
        return [
            _Lines(name, now["head"], at, min(at + SPLIT, now["end"]), begin[name])
            for name, now in end.items()
            for at in range(begin[name], now["end"], SPLIT)
        ]

    def read(self, partition: _Lines) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        with store.open_input_file(_find(store, root, partition)) as file:
            at, rest = partition.start, b""
            if at > partition.first:  # the line that goes on here belongs to the task before
                at -= 1
                rest = None
            size = file.size()
            while at < size and (rest is None or rest or at < partition.end):
                data = file.read_at(min(CHUNK, size - at), at)
                at += len(data)
                if rest is None:
                    cut = data.find(b"\n")
                    if cut < 0:
                        continue
                    data, rest = data[cut + 1 :], b""
                data = rest + data
                begin = at - len(data)
                whole = data.rfind(b"\n") + 1
                lines, rest = data[:whole], data[whole:]
                if begin + whole >= partition.end:  # of these, the lines that begin before the end
                    last = lines.find(b"\n", max(0, partition.end - 1 - begin))
                    lines, rest = (lines[: last + 1] if begin < partition.end else b""), b""
                    at = size
                if lines:
                    texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[:-1].split(b"\n")]
                    yield pa.RecordBatch.from_pydict({"value": pa.array(texts, pa.string())})

    def commit(self, end: dict) -> None:
        pass


def _goes_on(was: dict, now: dict) -> bool:
    return now["end"] >= was["end"] and base64.b64decode(now["head"]).startswith(base64.b64decode(was["head"]))


def _last_line_end(file, size: int) -> int:
    at = size
    while at > 0:
        start = max(0, at - (64 << 10))
        cut = file.read_at(at - start, start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        at = start
    return 0


def _find(store, root: str, lines: _Lines) -> str:
    """The file that begins with the right bytes: under its name or, if it was rotated meanwhile, another."""
    head = base64.b64decode(lines.head)
    names = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.size >= lines.end]
    for path in sorted(names, key=lambda p: (p.rsplit("/", 1)[-1] != lines.name, p)):
        with store.open_input_file(path) as file:
            if file.read_at(len(head), 0) == head:
                return path
    raise FileNotFoundError(f"{lines.name} in {root} was removed before it was read")


class GrowingText(DataSource):
    """``spark.readStream.format("growing_text").load(folder)``: a column ``value``, a line each."""

    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> _Follower:
        return _Follower(self.options["path"])
