"""Dataset formats as Python data sources, and image corpora.

``register(spark)`` makes two formats known:

* ``trec_run``: rankings as lines of ``query Q0 doc rank score tag``, columns query, doc, rank, score, tag.
* ``json_array``: files that hold one JSON array each, columns file, ordinal, item (the element's JSON text).

Both read a file or a folder; folders named ``key=value`` add columns, as Spark's own formats have them. A file of lines is cut into
ranges of ``split_mb`` megabytes (64), each a task; of an array a task holds one element at a time. Equality and IN filters on folder columns
leave out files before they are read, and those on ``query`` leave out lines before they are parsed (where ``spark.sql.python.filterPushdown.enabled``
is set). Paths are what Python opens on the driver and on executors: local, mounted, or with ``file:``.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

_FIELDS = {
    "trec_run": [("query", T.StringType()), ("doc", T.StringType()), ("rank", T.IntegerType()), ("score", T.DoubleType()), ("tag", T.StringType())],
    "json_array": [("file", T.StringType()), ("ordinal", T.LongType()), ("item", T.StringType())],
}


def _files(path: str) -> list[tuple[str, dict[str, str]]]:
    """The files at a path with the values of their ``key=value`` folders, by name; hidden ones are left out."""
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isfile(path):
        return [(path, {})]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    found = []
    for folder, inside, names in os.walk(path):
        inside[:] = sorted(d for d in inside if not d.startswith((".", "_")))
        values = dict(p.split("=", 1) for p in os.path.relpath(folder, path).split(os.sep) if "=" in p)
        found += [(os.path.join(folder, n), values) for n in sorted(names) if not n.startswith((".", "_"))]
    return sorted(found)


@dataclass
class Part(InputPartition):
    """A range of bytes of a file, and the values of its folders."""

    file: str
    start: int
    end: int
    values: tuple


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, folders: list[str], split: int):
        self.path, self.folders, self.split = path, folders, split
        self.names = [f.name for f in schema]
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column is None or column not in self.keys():
                yield f
                continue
            values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
            self.wanted[column] = self.wanted.get(column, values) & values

    def keys(self) -> list[str]:
        return self.folders

    def partitions(self) -> list[Part]:
        parts = []
        for file, values in _files(self.path):
            if all(values.get(c) in kept for c, kept in self.wanted.items() if c in self.folders):
                size = os.path.getsize(file)
                of = tuple(values.get(c) for c in self.folders)
                parts += [Part(file, a, min(a + self.split, size), of) for a in range(0, size, self.split)] if self.split else [Part(file, 0, size, of)]
        return parts


class _TrecReader(_Reader):
    def keys(self) -> list[str]:
        return [*self.folders, "query"]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        kept = self.wanted.get("query")
        if partition is None:  # no file is left
            return
        with open(partition.file, "rb") as f:
            if partition.start:  # a line belongs to the range it starts in
                f.seek(partition.start - 1)
                f.readline()
            while f.tell() < partition.end and (line := f.readline()):
                if kept is not None and line.split(None, 1)[:1] and line.split(None, 1)[0].decode() not in kept:
                    continue
                parts = line.decode("utf-8").split()
                if not parts:
                    continue
                if len(parts) != 6:
                    raise ValueError(f"{partition.file}: not a line of a ranking: {line[:200]!r}")
                yield (parts[0], parts[2], int(parts[3]), float(parts[4]), parts[5], *partition.values)


def array_items(read, size: int = 1 << 20) -> Iterator[object]:
    """The elements of one JSON array, from a function that reads some characters more; one element is held at a time."""
    decoder, held, at, more = json.JSONDecoder(), "", 0, True

    def char() -> str:
        """The next character that is no blank."""
        nonlocal held, at, more
        while True:
            while at < len(held) and held[at] in " \t\r\n":
                at += 1
            if at < len(held) or not more:
                return held[at : at + 1]
            held, at = read(size), 0
            more = bool(held)

    if char() != "[":
        raise ValueError("not a JSON array")
    at += 1
    if char() == "]":
        return
    while True:
        char()
        while True:
            try:
                item, end = decoder.raw_decode(held, at)
                if held[end : end + 1] in tuple(" \t\r\n,]") or not more:  # else a number may go on
                    break
            except ValueError:
                if not more:
                    raise
            got = read(size)
            more = bool(got)
            held, at = held[at:] + got, 0
        yield item
        at = end
        mark = char()
        if mark == "]":
            return
        if mark != ",":
            raise ValueError("the JSON array ends early")
        at += 1


class _ArrayReader(_Reader):
    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:
            return
        with open(partition.file, encoding="utf-8-sig") as f:
            for i, item in enumerate(array_items(f.read)):
                yield (partition.file, i, json.dumps(item, ensure_ascii=False), *partition.values)


class _Files(DataSource):
    def schema(self) -> T.StructType:
        folders = sorted({k for _, values in _files(self.options["path"]) for k in values})
        return T.StructType([*[T.StructField(n, k) for n, k in _FIELDS[self.name()]], *[T.StructField(c, T.StringType()) for c in folders]])

    def _reader(self, kind: type[_Reader], schema: T.StructType, split: int) -> _Reader:
        own = len(_FIELDS[self.name()])
        return kind(self.options["path"], schema, [f.name for f in schema][own:], split)


class TrecRun(_Files):
    @classmethod
    def name(cls) -> str:
        return "trec_run"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return self._reader(_TrecReader, schema, max(1, int(float(self.options.get("split_mb", 64)) * (1 << 20))))


class JsonArray(_Files):
    @classmethod
    def name(cls) -> str:
        return "json_array"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return self._reader(_ArrayReader, schema, 0)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    for source in (TrecRun, JsonArray):
        spark.dataSource.register(source)


def image_size(data: bytes) -> tuple[str | None, int | None, int | None]:
    """Format, width and height from the header of a PNG, GIF, BMP, WebP or JPEG image; nulls for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return "bmp", width, abs(height)
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a start of frame
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", width, height
            at += 2 if mark in (0x01, 0xFF) or 0xD0 <= mark <= 0xD7 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return "jpeg", None, None
    return None, None, None


def images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modified, format, width, height)`` of the image files below a path, which Spark lists and reads; sizes come from headers.

    What is no known image has null format, width and height; Spark leaves out empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [image_size(x.as_buffer().to_pybytes()) for x in batch.column(3)]
            kinds, widths, heights = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kinds, pa.string()), pa.array(widths, pa.int32()), pa.array(heights, pa.int32())], names=["path", "length", "modified", "format", "width", "height"])

    head = files.select("path", "length", "modificationTime", "content")
    out = T._parse_datatype_string("path string, length long, modified timestamp, format string, width int, height int")
    return head.mapInArrow(run, out)
