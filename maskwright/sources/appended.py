"""Lines appended to files, as a stream: each complete line once, across growth, rotation, truncation and restarts.

The offset of the stream says for every file how far its complete lines reach and what its first line is (a checksum).
A file is known again by its first line, not by its name: one that was renamed goes on where it was, and another file
under an old name, or one that has become shorter, is read from its beginning. What stands behind the last line end
waits for the rest of its line.

Offsets are made from a listing and the two ends of each file alone, so a restarted stream needs nothing but its
checkpoint. A large range is cut into pieces that are read by different tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "appended_lines"
PIECE_BYTES = 64 << 20
BLOCK = 1 << 20
HEAD = 1 << 16
SCHEMA = "value string, path string, offset long"


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin at or behind `begin` and before `end`; those before `first` aren't wanted."""

    path: str
    head: str
    first: int
    begin: int
    end: int


class AppendedLines(DataSource):
    """`spark.readStream.format("appended_lines").load(path)`: `value`, the `path` of the file and the `offset` of the line.

    The path is a folder, whose files are followed unless their names begin with a dot or an underscore, or one file,
    followed with those that it is rotated to (its name with something behind a dot or hyphen). One that isn't there yet
    is empty. Option `failOnDataLoss`: whether lines that are gone before they were read are an error (true) or left out.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LinesReader:
        return LinesReader(self.options)


class LinesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.strict = str(options.get("failOnDataLoss", "true")).lower() != "false"
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = store_of(self.path)
        found = {}
        for file in _files(store, root):
            with store.open_input_file(file.path) as data:
                head = _head(data)
                at = _complete(data, data.size()) if head else 0
            if at:
                found[file.path] = {"head": head, "at": at}
        return found

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for path, now in end.items():
            first = _known(path, now["head"], start, end)
            first = first if first <= now["at"] else 0
            for begin in range(first, now["at"], self.piece):
                pieces.append(Piece(path, now["head"], first, begin, min(begin + self.piece, now["at"])))
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, root = store_of(self.path)
        path = _present(store, root, partition)
        if path is None:
            if self.strict:
                raise RuntimeError(f"lines of {partition.path} are gone; failOnDataLoss=false leaves them out")
            return
        with store.open_input_file(path) as data:
            values, places, size = [], [], 0
            for at, line in _lines(data, partition):
                values.append(line.decode("utf-8", "replace"))
                places.append(at)
                size += len(line)
                if size > BLOCK or len(values) >= 10_000:
                    yield _batch(values, path, places)
                    values, places, size = [], [], 0
            if values:
                yield _batch(values, path, places)


def _batch(values: list[str], path: str, places: list[int]) -> pa.RecordBatch:
    columns = [pa.array(values, pa.string()), pa.array([path] * len(values), pa.string()), pa.array(places, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["value", "path", "offset"])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path or URI names and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _files(store: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    root = root.rstrip("/")
    if store.get_file_info(root).type == fs.FileType.Directory:
        listed = store.get_file_info(fs.FileSelector(root))
        named = [f for f in listed if not f.base_name.startswith((".", "_"))]
    else:
        folder = root.rpartition("/")[0]
        listed = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        named = [f for f in listed if f.path == root or f.path.startswith((root + ".", root + "-"))]
    return [f for f in named if f.type == fs.FileType.File and f.size]


def _head(data) -> str | None:
    """What a file is known by: the checksum of its first line, of as much of it as `HEAD`. None for less than that."""
    first = data.read_at(min(HEAD, data.size()), 0)
    line, end, _ = first.partition(b"\n")
    return f"{len(line)}-{zlib.crc32(line)}" if end or len(first) == HEAD else None


def _complete(data, size: int) -> int:
    """Behind the last line end; 0 if there is none."""
    end = size
    while end:
        begin = max(0, end - HEAD)
        at = data.read_at(end - begin, begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def _known(path: str, head: str, start: dict, end: dict) -> int:
    """How far a file was read: under its name, or under a name that it has left."""
    before = start.get(path)
    if before and before["head"] == head:
        return before["at"]
    for other, was in start.items():
        if was["head"] == head and end.get(other, {}).get("head") != head:
            return was["at"]
    return 0


def _present(store: fs.FileSystem, root: str, piece: Piece) -> str | None:
    """Where the file of a piece is now: it may have been renamed since the offsets were taken."""
    files = _files(store, root)
    for file in sorted(files, key=lambda f: f.path != piece.path):
        with store.open_input_file(file.path) as data:
            if data.size() >= piece.end and _head(data) == piece.head:
                return file.path
    return None


def _lines(data, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """Place and text of the lines that begin inside a piece."""
    # a piece begins inside a line unless a line ends right before it
    at = piece.begin - 1 if piece.begin > piece.first else piece.begin
    skip, rest, here = piece.begin > piece.first, [], at
    while at < piece.end:
        block = data.read_at(BLOCK, here)
        if not block:
            return
        here += len(block)
        *whole, left = block.split(b"\n")
        for part in whole:
            line = b"".join([*rest, part])
            rest = []
            if at >= piece.end:
                return
            if not skip:
                yield at, line.removesuffix(b"\r")
            skip = False
            at += len(line) + 1
        rest.append(left)


def follow_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The lines of a growing file, or of the files of a folder, as a stream; see `AppendedLines`."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format(NAME).options(**options).load(path)
