"""Token ids in a directly addressable binary format.

Ids are cut into 8-bit chunk levels. Level 0 holds the low chunk of every id; a continuation bitmap marks the ids
that go on, and the next level holds only their next chunk, in the same order. A rank directory (ones before each
block of 512 bits) finds an id's place in the next level, so ``DacReader.access(i)`` reads any id from a few bytes
per level, without decoding a block.

Files: a Parquet table with a row per segment, so that any store Spark writes to can hold them:
``part, seq, part_offset`` (ids of the part before the segment), ``n_tokens, doc_ids, lengths, payload``.
Segments are in ascending doc_id order by (part, seq).

Scale: one range shuffle of the texts puts documents in order; ids are made after it and never shuffled. The driver
gets one total per part. A segment closes at ``segment_tokens``; a document is never divided between segments.

Edge cases: a null text is an empty one and holds the end id only. Null doc_ids come first. Rows of equal doc_id
follow each other by text. An empty table gives an empty table.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm._shared import Recent, Scratch, resident

MAGIC, BLOCK = b"DAC1", 512


def dac_encode(ids: np.ndarray) -> bytes:
    """Layout: magic, number of ids, of levels; per level: its size, chunks, bitmap, rank directory."""
    levels, rest = [], np.ascontiguousarray(ids, dtype=np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(rest), BLOCK)) if len(rest) else np.zeros(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4") if len(rest) else np.zeros(0, "<u4")
        levels += [struct.pack("<I", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        if not more.any():
            break
        rest = rest[more] >> 8
    return b"".join([MAGIC, struct.pack("<II", len(ids), len(levels) // 4), *levels])


class DacReader:
    """Reads a payload: ``access(i)`` for one id, ``slice(a, b)`` for a run of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token payload")
        self.n, n_levels = struct.unpack_from("<II", data, 4)
        at, self.levels = 12, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + n)
            at += n + len(bits)
            ranks = np.frombuffer(data, "<u4", -(-n // BLOCK), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // BLOCK
        if block >= len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[(len(ranks) - 1) * BLOCK // 8 :]).sum()) if len(ranks) else 0
        start, end = block * BLOCK // 8, i // 8
        ones = int(ranks[block]) + int(np.bitwise_count(bits[start:end]).sum())
        return ones + (int(bits[end]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        return self._slice(0, a, b)

    def _slice(self, k: int, a: int, b: int) -> np.ndarray:
        chunks, bits, ranks = self.levels[k]
        out = chunks[a:b].astype("<u4")
        first = a // 8
        more = np.unpackbits(bits[first : -(-b // 8)], bitorder="little")[a - 8 * first : b - 8 * first].astype(bool)
        if more.any():
            start = self._rank(bits, ranks, a)
            out[more] |= self._slice(k + 1, start, start + int(more.sum())) << 8
        return out


#: Characters that are their own normal form, with the same lower case and class in Python and in the tokenizer.
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧‰-⁞€]|<\\|")
_WORD = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordEncoder:
    """The tokenizers library over distinct words, for vocabularies with word ends that drop white space.

    Plain Latin texts are lower-cased and cut at white space as Arrow columns; each distinct piece of a batch is encoded
    once and kept as packed ids while it is in use, in two rounds of about ``max_bytes`` each. All other texts go to the
    library whole.
    """

    def __init__(self, path: str, max_bytes: int = 120_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.words):
            t.no_truncation()
            t.no_padding()
        steps = (json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if steps[-1].get("type") == "ByteLevel" and not steps[-1]["add_prefix_space"]:
            # for words that are cut and normal already
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pieces = Recent(max_bytes)

    def _ids(self, text: str, words: bool = False) -> np.ndarray:
        """Ids of a text, or of words between spaces."""
        return np.array((self.words if words else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: set[str]) -> None:
        """Pieces that aren't one word are cut into words, which are learned with the rest."""
        parts = {p: _WORD.findall(p) for p in pieces if not p.isalpha()}
        words = self.pieces.lacking(pieces.difference(parts).union(*parts.values()).difference(parts))
        words.update(w for p, ws in parts.items() if len(ws) == 1 and ws[0] == p for w in ws)
        new = list(words)
        found: dict[str, bytes] = {}
        for i in range(0, len(new), 4000):
            group = new[i : i + 4000]
            ids = self._ids(" ".join(group), words=True)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                raw, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                found.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))  # noqa: B905
            else:
                found.update((w, self._ids(w).tobytes()) for w in group)
        self.pieces.add(found)
        get = self.pieces.now.__getitem__
        self.pieces.add({p: b"".join(map(get, ws)) for p, ws in parts.items() if p not in found})

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, and how many each has; a null is an empty text."""
        collects = gc.isenabled()
        gc.disable()  # no cycle holds the many words and lists that are made here
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        other = [i for i, t in enumerate(texts.to_pylist()) if t and _is_other(t)]
        plain = pc.fill_null(texts, "")
        if other:
            mask = np.zeros(len(texts), bool)
            mask[other] = True
            plain = pc.if_else(pa.array(mask), "", plain)
        cut = pc.utf8_split_whitespace(pc.utf8_lower(plain))
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        self.pieces.turn()
        raw = list(map(self.pieces.now.get, pieces))
        if missing := [i for i, r in enumerate(raw) if r is None]:
            unknown = {pieces[i] for i in missing}
            unknown.discard("")
            if lacking := self.pieces.lacking(unknown):
                self._learn(lacking)
            get = self.pieces.now.get
            for i in missing:
                raw[i] = get(pieces[i], b"")
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids, start = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.cumsum(n)
        ids = ids[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        counts = np.diff(offsets)
        if other:
            whole = {i: self._ids(texts[i].as_py()) for i in other}
            ids = np.concatenate([np.zeros(0, "<u4"), *(whole[i] if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)))])
            counts[other] = [len(x) for x in whole.values()]
        return ids, counts


def _is_other(text: str) -> bool:
    if text.isascii():
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _OTHER.search(text) is not None


def _runs(texts: pa.Array, size: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, stop
        start = stop


def _segments_schema(doc_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("seq", T.IntegerType()),
            T.StructField("part_offset", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(doc_id)),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )


def segments(docs: DataFrame, path: str, end_id: int = 2, segment_tokens: int = 500_000) -> DataFrame:
    """Rows of the file format for ``docs(doc_id, text)``, in ascending doc_id order by (part, seq)."""
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, part = resident(("words", path), lambda: WordEncoder(path)).encode, TaskContext.get().partitionId()
        keys, lengths, raw, held, seq, before = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            payload = dac_encode(np.concatenate(raw))
            arrays = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([pa.concat_arrays(keys)], pa.list_(kind)), pa.array([np.concatenate(lengths)], pa.list_(pa.int32())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "part_offset", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in _runs(batch.column(1)):
                ids, counts = encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, np.cumsum(counts), end_id)  # after each document
                counts += 1
                stops, done = np.cumsum(counts), 0
                while done < len(counts):  # documents up to the one that fills the segment
                    start = int(stops[done - 1]) if done else 0
                    last = min(int(np.searchsorted(stops, start + segment_tokens - held)) + 1, len(counts))
                    keys.append(batch.column(0).slice(a + done, last - done))
                    lengths.append(counts[done:last])
                    raw.append(ids[start : stops[last - 1]])
                    held += int(stops[last - 1]) - start
                    done = last
                    if held >= segment_tokens:
                        yield row()
                        before, seq = before + held, seq + 1
                        keys, lengths, raw, held = [], [], [], 0
        if held:
            yield row()

    return ordered.mapInArrow(run, _segments_schema(ordered.schema["doc_id"].dataType))


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, segment_tokens: int = 500_000) -> None:
    """Writes the files to a folder that Spark's readers can reach."""
    segments(docs, path, end_id, segment_tokens).write.mode("overwrite").parquet(folder)


def read(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, and ``first_id`` by random access."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per part of the write
    base = dict(zip((r.part for r in totals), accumulate((r.n for r in totals), initial=0)))  # noqa: B905

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, offset, _, ids, lengths, payload = (c[i] for c in batch.columns)
                reader, lengths = DacReader(payload.as_buffer().to_pybytes()), np.array(lengths.as_py(), np.int64)
                stops = np.cumsum(lengths)
                every = reader.slice(0, reader.n)
                raw = memoryview(every.tobytes())
                start = base[part.as_py()] + offset.as_py()
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                first = [reader.access(b - n) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(stops - lengths + start), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(first, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id"]
                )

    kind = files.schema["doc_ids"].dataType.elementType
    longs = [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32", "first_id")]
    return files.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *longs]))


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared scratch folder and reads them back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = f"{scratch.root}/files"
    write(docs, path, folder, end_id)
    return read(docs.sparkSession.read.schema(_segments_schema(docs.schema["doc_id"].dataType)).parquet(folder)).select("doc_id", "start", "n_tokens", "ids_crc32", "first_id")
