"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows.

A document's text is normalised to ``" w1 w2 ... wn "`` and scanned once; the automaton's patterns are the
items' windows in the same form, so a match always covers whole words. Word numbers of matches map back to
offsets of the original text.

Scale: the scan is a map over the documents, without a shuffle. An automaton of more than ``max_block_chars`` pattern
characters is cut into blocks of items, which the driver fetches, sends and drops one after the other; the documents
are scanned once for each block.

Edge cases: a null or word-less text has no words, no hits and is not contaminated. An item without words
matches nothing. Items with a null id count as hits but are not listed. Rows of equal item_id are one item.
A repeated document row gives a repeated result row. Extra columns of ``docs`` pass through ``scan``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm._shared import Scratch, resident, slices, without

WINDOW = 13
#: Lower-cases A-Z; every other ASCII character that is no letter or digit becomes a space. Bytes over 0x7F stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[str, int]]:
    """Patterns of an item with their length in words. Bytes are held as Latin-1 characters, one each."""
    if not words:
        return []
    n = min(size, len(words))
    return [(" " + b" ".join(words[i : i + n]).decode("latin-1") + " ", n) for i in range(len(words) - n + 1)]


def build_automaton(items: list[tuple[str | None, str | None]], size: int = WINDOW):
    """The automaton of ``(item_id, text)`` rows; each pattern's value: (words, ids of the items it is in)."""
    import ahocorasick

    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        for pattern, n in windows_of(words_of(text), size):
            found.setdefault(pattern, (n, set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for pattern, (n, ids) in found.items():
        automaton.add_word(pattern, (n, frozenset(ids - {None})))
    if found:
        automaton.make_automaton()
    return automaton if found else None


def scan_text(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """``(n_words, covered word ranges [first, end), ids of items found)``. One pass over the text."""
    words = words_of(text)
    ranges: list[tuple[int, int]] = []
    items: set = set()
    if words and automaton is not None:
        line = b" ".join([b"", *words, b""]).decode("latin-1")
        at = last = 0  # spaces before the character at
        for end, (n, ids) in automaton.iter(line):
            last += line.count(" ", at, end)
            at = end
            items |= ids
            if ranges and last - n <= ranges[-1][1]:  # matches come by their end; a longer one may reach back
                start = min(last - n, ranges[-1][0])
                while len(ranges) > 1 and ranges[-2][1] >= start:
                    ranges.pop()
                    start = min(start, ranges[-1][0])
                ranges[-1] = (start, last)
            else:
                ranges.append((last - n, last))
    return len(words), ranges, items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of ranges of words."""
    import re

    if not ranges:
        return []
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_ranges", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _blocks(benchmark: DataFrame, max_block_chars: int, size: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of bounded pattern size, one after the other; the driver holds a block and a partition."""
    now, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        cost = len(row.t or "") * size
        if now and chars + cost > max_block_chars:
            yield now
            now, chars = [], 0
        now.append((row.i, row.t))
        chars += cost
    if now:
        yield now


def scan(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_chars: int = 64_000_000, spans: bool = True, column: str = "scan"
) -> DataFrame:
    """``docs`` with a last struct column: n_words, covered word ranges, their spans in the original, item ids.

    An input column of the same name is replaced. One block of items, as nearly any benchmark is, is one pass without
    a shuffle. Of several, each is scanned for and its hits are written before the next is read, so that no more than
    one automaton is held anywhere; then hits meet their texts by a hash.
    """
    docs, context = docs.select(*without(docs, column)), docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField(column, SCAN)])
    blocks = _blocks(benchmark, max_block_chars, window)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_scanner(context.broadcast(first), uuid.uuid4().hex, window, spans, at, column), out)
    scratch, hits = Scratch(docs.sparkSession, "hits"), None
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit("g"), "text").alias("g"), "text")
    for i, block in enumerate(chain([first, second], blocks)):
        shared = context.broadcast(block)
        found = texts.mapInArrow(_scanner(shared, uuid.uuid4().hex, window, False, 2, "scan"), T.StructType([*texts.schema.fields, T.StructField("scan", SCAN)]))
        part = scratch.keep(found.where(F.size("scan.items") + F.size("scan.word_ranges") > 0).select("h", "g", "scan.word_ranges", "scan.items").dropDuplicates(["h", "g"]), f"block-{i}")
        hits = part if hits is None else hits.unionByName(part)
        shared.destroy()
    met = hits.groupBy("h", "g").agg(F.flatten(F.collect_list("word_ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[at]
    plain = docs.toDF(*names)
    joined = plain.join(met, (F.xxhash64(text) == F.col("h")) & (F.xxhash64(F.lit("g"), text) == F.col("g")), "left").select(*names, "ranges", "items")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, ranges, items in zip(*(c.to_pylist() for c in (batch.column(at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))), strict=True):
                covered = merge([tuple(r) for r in ranges or ()])
                rows.append({"n_words": len(words_of(text)), "word_ranges": covered, "spans": original_spans(text, covered) if spans else [], "items": sorted(items or ())})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, _ARROW)], names=[*names, column])

    return joined.mapInArrow(gather, T.StructType([*plain.schema.fields, T.StructField(column, SCAN)])).toDF(*docs.columns, column)


def _scanner(shared, key: str, window: int, spans: bool, at: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = resident(("automaton", key), lambda: build_automaton(shared.value, window))  # the tasks of one scan share it
        for batch in slices(batches):
            rows = []
            for text in batch.column(at).to_pylist():
                n, ranges, items = scan_text(automaton, text)
                rows.append({"n_words": n, "word_ranges": ranges, "spans": original_spans(text, ranges) if spans else [], "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, column])

    return run


_ARROW = pa.struct([("n_words", pa.int64()), ("word_ranges", pa.list_(pa.list_(pa.int64()))), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    found = scan(docs.select("doc_id", "text"), benchmark, window, spans=False)
    hit = F.aggregate("scan.word_ranges", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return found.select("doc_id", F.col("scan.n_words").alias("n_words"), hit.alias("n_hit"), F.col("scan.items").alias("items")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated ones; same columns. The scan filters in its own pass, without a join."""
    column = f"scan_{uuid.uuid4().hex}"
    hit = F.aggregate(f"{column}.word_ranges", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return scan(docs, benchmark, window, spans=False, column=column).where(~((hit > 0) & (share * hit >= F.col(f"{column}.n_words")))).drop(column)
