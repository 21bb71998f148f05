"""A streaming source of the lines that are appended to files: an offset is a byte place in each file."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string"
#: Bytes read at once; bytes of a file's first line that tell it from another file of that name; bytes of a task.
BLOCK, HEAD, SPLIT = 1 << 16, 1 << 12, 64 << 20


class Piece(InputPartition):
    """Lines of a file that begin in [low, high); the range before `end` is complete lines, and `first` is where one begins."""

    def __init__(self, file: str, first: int, low: int, high: int, end: int) -> None:
        self.file, self.first, self.low, self.high, self.end = file, first, low, high, end


class AppendedLines(DataSource):
    """`spark.readStream.format("appended_lines").option("path", folder).load()`: (file, at, line), `at` the byte a line begins at.

    Lines appended to a file are read once, also over restarts from a checkpoint. A last line without its end is held back until it is
    whole. A file that shrank, or whose first line is another, counts as new and is read from its start. Blank lines are dropped; bytes that
    aren't UTF-8 are replaced. A large range is dealt to several tasks. The folder is any that Arrow's file systems open, shared by
    all executors: a mounted path or a URI. Options: path, suffix (.jsonl), splitBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("splitBytes", SPLIT)))


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, split: int) -> None:
        self.path, self.suffix, self.split = path, suffix, split

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file: {end: after its last whole line, head: what tells the file}} of every file that has a whole line."""
        store, folder = self._open()
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        out = {}
        for info in sorted(found, key=lambda i: i.path):
            if info.type == fs.FileType.File and info.base_name.endswith(self.suffix) and info.size:
                with store.open_input_file(info.path) as f:
                    end = whole_lines(f, info.size)
                    if end:
                        f.seek(0)
                        out[info.path] = {"end": end, "head": zlib.crc32(f.read(min(HEAD, end)).split(b"\n", 1)[0])}
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        pieces = []
        for file, now in end.items():
            was = start.get(file)
            begin = was["end"] if was and was["head"] == now["head"] and was["end"] <= now["end"] else 0
            pieces += [Piece(file, begin, low, min(low + self.split, now["end"]), now["end"]) for low in range(begin, now["end"], self.split)]
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        with store.open_input_file(piece.file) as f:
            rows: list[tuple[int, bytes]] = []
            held = 0
            for at, line in lines_from(f, piece):
                if line.strip():
                    rows.append((at, line))
                    held += len(line)
                if held >= BLOCK * 16:
                    yield batch_of(piece.file, rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(piece.file, rows)


def batch_of(file: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([file] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), pa.array([line.decode("utf-8", "replace") for _, line in rows])]
    return pa.RecordBatch.from_arrays(columns, names=["file", "at", "line"])


def whole_lines(f: pa.NativeFile, size: int) -> int:
    """The place after the last line end, 0 without one; read from the back."""
    at = size
    while at:
        low = max(0, at - BLOCK)
        f.seek(low)
        cut = f.read(at - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        at = low
    return 0


def lines_from(f: pa.NativeFile, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the piece's range, the last of them read beyond it to its end."""
    at = piece.low
    if at > piece.first:  # a line that began before belongs to the piece before
        at -= 1
    f.seek(at)
    skip, rest, begin = at < piece.low, b"", at
    while at < piece.end:
        block = f.read(min(BLOCK, piece.end - at))
        if not block:
            return
        at += len(block)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if skip:
                skip = False
            elif begin >= piece.high:
                return
            else:
                yield begin, line.rstrip(b"\r")
            begin += len(line) + 1
        if begin >= piece.high and not skip:
            return
