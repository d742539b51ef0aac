"""Table functions for SQL: pieces of texts, windows of tokens, and flat metrics, over any table given as an argument.

``analyze`` makes the output's columns from the arguments, so keys keep their names and types, and wrong arguments are told
before anything runs. Rows move as Arrow batches. ``register(spark)`` offers them to SQL:

    SELECT * FROM text_pieces(TABLE(documents), 'doc_id', 'text', 1000, 100)
    SELECT * FROM token_windows(TABLE(SELECT page, text FROM pages) PARTITION BY (page), 'page', 'text', 200, 50)
    SELECT * FROM flat_metrics(TABLE(runs), 'run_id', 'metrics')
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docquarry.operators.blocks import split_pieces

_WORDS = re.compile(r"\w+")


def _named(table: AnalyzeArgument, *names: AnalyzeArgument) -> list[T.StructField]:
    """The fields of the table that these arguments name, in any case."""
    if not table.isTable:
        raise ValueError("the first argument is a table")
    fields = {f.name.lower(): f for f in table.dataType}
    found = []
    for name in names:
        if not isinstance(name.value, str) or name.value.lower() not in fields:
            raise ValueError(f"no column {name.value!r} in the table; it has {', '.join(f.name for f in table.dataType)}")
        found.append(fields[name.value.lower()])
    return found


def _positive(**values: AnalyzeArgument) -> None:
    for name, v in values.items():
        if v.value is None or v.value < (0 if name == "overlap" else 1):
            raise ValueError(f"{name} is {v.value}")


@dataclass
class Columns(AnalyzeResult):
    """The output's schema, and the names of the table's columns that the arguments mean."""

    names: list[str] = field(default_factory=list)


def _result(of: list[T.StructField], *more: T.StructField) -> Columns:
    return Columns(T.StructType([of[0], *more]), names=[f.name for f in of])


class _OverTable:
    """Takes each row's key and text by the names that ``analyze`` found."""

    def __init__(self, analyzed: Columns):
        self.names = analyzed.names

    def of(self, row: Row) -> tuple:
        return tuple(row[n] for n in self.names)


class TextPieces(_OverTable):
    """``(key, piece, content)`` of each text: see ``operators.blocks.split_pieces``."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> Columns:
        of = _named(table, key, text)
        _positive(size=size, overlap=overlap)
        return _result(of, T.StructField("piece", T.IntegerType()), T.StructField("content", T.StringType()))

    def eval(self, table: Row, key: str, text: str, size: int, overlap: int) -> Iterator[tuple]:
        of, said = self.of(table)
        for i, piece in enumerate(split_pieces(said, size, overlap) if said else ()):
            yield of, i, piece


class TokenWindows(_OverTable):
    """``(key, window, first, last, content)``: windows of ``size`` words, each starting ``size - overlap`` words after the one before."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> Columns:
        of = _named(table, key, text)
        _positive(size=size, overlap=overlap)
        if overlap.value >= size.value:
            raise ValueError("windows have to move on: overlap is not under size")
        numbers = [T.StructField(c, T.IntegerType()) for c in ("window", "first", "last")]
        return _result(of, *numbers, T.StructField("content", T.StringType()))

    def eval(self, table: Row, key: str, text: str, size: int, overlap: int) -> Iterator[tuple]:
        of, said = self.of(table)
        spans, step = [m.span() for m in _WORDS.finditer(said or "")], size - overlap
        for n, a in enumerate(range(0, max(1, len(spans) - size + step), step) if spans else ()):
            b = min(a + size, len(spans)) - 1
            yield of, n, a, b, said[spans[a][0] : spans[b][1]]


def numbers_of(node: object, path: tuple[str, ...] = (), n: int | None = None) -> Iterator[tuple[str, str, float, int | None]]:
    """``(path, name, value, n)`` of the numbers in nested objects; n is the "count" of the nearest level that has one."""
    if isinstance(node, dict):
        count = node.get("count")
        n = int(count) if isinstance(count, int | float) and not isinstance(count, bool) else n
        for name, value in node.items():
            if isinstance(value, dict):
                yield from numbers_of(value, (*path, name), n)
            elif isinstance(value, int | float) and not isinstance(value, bool):
                yield ".".join(path), name, float(value), n


class FlatMetrics(_OverTable):
    """``(key, path, name, value, n)`` of the numbers in JSON texts; a text that is no JSON has none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, metrics: AnalyzeArgument) -> Columns:
        of = _named(table, key, metrics)
        texts = [T.StructField(c, T.StringType()) for c in ("path", "name")]
        return _result(of, *texts, T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType()))

    def eval(self, table: Row, key: str, metrics: str) -> Iterator[tuple]:
        of, said = self.of(table)
        try:
            held = json.loads(said or "null")
        except ValueError:
            return
        for found in numbers_of(held):
            yield of, *found


NAMES = {"text_pieces": TextPieces, "token_windows": TokenWindows, "flat_metrics": FlatMetrics}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    for name, function in NAMES.items():
        spark.udtf.register(name, udtf(function, useArrow=True))
