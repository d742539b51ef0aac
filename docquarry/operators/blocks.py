"""Text of parsed blocks, page masks, node relevance, and splitters that look at characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import normalize_block


def span_text(spans: Column) -> Column:
    """Spans of (kind, content) in a row; inline equations between dollar signs."""
    return F.array_join(F.transform(spans, lambda s: F.when(s["kind"] == "equation_inline", F.concat(F.lit("$"), s["content"], F.lit("$"))).otherwise(s["content"])), "")


def block_text(kind: Column, caption: Column, body: Column, footnote: Column) -> Column:
    """Text of a block: images and charts by body, caption, footnote; tables and code by caption, body, footnote; else the body."""
    join = lambda *parts: F.array_join(F.filter(F.array(*[normalize_block(p) for p in parts]), lambda x: x != ""), "\n")
    return F.when(kind.isin("image", "chart"), join(body, caption, footnote)).when(kind.isin("table", "code", "algorithm"), join(caption, body, footnote)).otherwise(normalize_block(body))


def allowed_pages(n: Column, limit: int) -> Column:
    """Page indices 0 to min(n, limit) - 1."""
    last = F.least(n, F.lit(limit)) - 1
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def clipped_pages(numbers: Column, n: Column) -> Column:
    """Sorted distinct page indices in [0, n)."""
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda p: (p >= 0) & (p < n))))


def in_mask(covered: Column, allowed: Column, pair_is_range: bool = False) -> Column:
    """Whether pages overlap a mask; a mask of two numbers is an inclusive range if asked for."""
    as_set = F.arrays_overlap(covered, allowed)
    if not pair_is_range:
        return as_set
    return F.when(F.size(allowed) == 2, F.exists(covered, lambda p: p.between(F.get(allowed, F.lit(0)), F.get(allowed, F.lit(1))))).otherwise(as_set)


def relevance(kind: Column, text: Column, terms: Column) -> Column:
    """Prior of a node's type, plus up to 10 for distinct question terms of 4 characters or more found in its text."""
    prior = F.when(kind.isin("title", "table", "figure", "image", "chart"), 8).when(kind.isin("paragraph", "text", "list"), 3).otherwise(0)
    return prior + F.least(F.lit(10), F.size(F.filter(F.array_distinct(terms), lambda t: (F.length(t) >= 4) & F.contains(text, t))))


def seeded_subset(rows: DataFrame, by: str, item: str, seed: int, n: int) -> DataFrame:
    """``n`` items of each group, drawn by a hash of seed, group and item: the same rows on every run."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(by).cast("string"), F.col(item).cast("string"))), item)
    return rows.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n)


def split_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Pieces of at most ``size`` characters that end after the last of the first separator found in their second half, each
    starting ``overlap`` before the end of the one before."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for s in separators:
                at = text.rfind(s, start + size // 2, end)
                if at >= 0:
                    end = at + len(s)
                    break
        out.append(text[start:end])
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def few(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in short ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def split_texts(rows: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """``(key, piece, content)``; a null or empty text has no piece. Batches of Arrow come in and go out, a few texts of one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            cut = [split_pieces(t, size, overlap) if t else [] for t in batch.column(1).to_pylist()]
            counts = [len(c) for c in cut]
            of = batch.column(0).take(pa.array(np.repeat(np.arange(len(cut)), counts)))
            places = pa.array([i for n in counts for i in range(n)], pa.int32())
            yield pa.RecordBatch.from_arrays([of, places, pa.array([p for c in cut for p in c], pa.string())], names=[key, "piece", "content"])

    return rows.select(key, text).mapInArrow(run, T.StructType([rows.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("content", T.StringType())]))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """The template with ``<name>`` marks filled in; a null is empty."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def missing_artifacts(samples: DataFrame, key: str, kinds: dict[str, DataFrame]) -> DataFrame:
    """Samples that lack artifacts, with the kinds they lack."""
    out = samples.select(key)
    for name, have in kinds.items():
        there = have.select(F.col(key).alias(f"{name}_key")).distinct()
        out = out.join(there, F.col(key) == F.col(f"{name}_key"), "left")
    lacking = F.filter(F.array(*[F.when(F.col(f"{n}_key").isNull(), F.lit(n)) for n in kinds]), lambda x: x.isNotNull())
    return out.select(key, lacking.alias("missing")).where(F.size("missing") > 0)


def without_image_links(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn(text, F.regexp_replace(text, r"!\[\]\([^)]*\)", ""))


def page_text(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``(*keys, text)``: a page's blocks, each as its type and index in brackets over its text, joined by blank lines.

    ``blocks(*keys, order, type, text)``; blocks without text are left out, a page without any is ``[EMPTY PAGE]``.
    """
    body = normalize_block(F.col("text"))
    part = F.when(body != "", F.concat(F.lit("["), "type", F.lit(" "), F.col(order).cast("string"), F.lit("]\n"), body))
    held = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(F.col(order).alias("at"), part.alias("part"))))).alias("parts"))
    text = normalize_block(F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n"))
    return held.select(*keys, F.coalesce(F.nullif(text, F.lit("")), F.lit("[EMPTY PAGE]")).alias("text"))
