"""Fuzzy line deduplication: blocks of lines by a prefix filter, edit similarity, one occurrence per connected group.

Lines are what newlines separate, of any length. Normalised (lower case, digits as 0, runs of other ASCII characters
that are no letters as one space; a character of a script without spaces is a word), equal lines are one, however
short; empty lines stay. Two different lines are linked if their edit similarity, 1 - edit distance / longer length,
both in words, is 0.8 or more. Of each connected group the first line of the document with the smallest doc_id
stays; all other occurrences go.

Blocks: a line's keys are the rarest of its pairs of neighbouring words, so many (0.4 of its words and one or two more) that
similar lines have one in common, whatever is edited (``prefix``). Words are counted first; only what is compared
depends on the counts, not the result. Keys that only one line has are dropped: hashes of all keys are dealt
out, and a bitmap of those met twice goes to the tasks. It only saves work; so do hash collisions cost some.

Representatives: lines of a block are sorted by their number of words and walked. A line that may be similar to a
representative met before (number of words; parities of its words by 128 hash classes, 256 for long lines, of which an
edit changes two at most) has one, any other becomes one; each is compared with all lines of the block that it may be similar to.
So a block of near copies gives rows in proportion to its lines. Then lines that have representatives, but are
in different groups by now, meet each other within their blocks (``across``; counts of their words by 256 classes tell
whether they may be similar). So each two similar lines have been compared or are in one group: no link is lost.

Scale: one pass over the texts makes all rows, another picks the texts to compare; block rows are dealt by range of block and
number of words, so a crowded block spreads over tasks, and the representatives at the borders of tasks meet once more.
Blocks in which lines of several groups meet are cut into sides of ``SIDE`` lines, a task for two of them. Bitmaps go
up to ``MAP_BITS``. Documents are shuffled once, for the result.

Edge cases: null and empty texts stay as they are. A document of which nothing is left keeps an empty text, with
n_removed over 0. Rows of null doc_id take no part but lose repeats within themselves. Rows of equal doc_id are one
document: each keeps what the document owns. Empty tables give empty results. Extra columns of ``docs`` pass through
``clean``; input columns named like its own (n_lines, n_removed, in any case) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from docquarry.llm._shared import Scratch, connected_components, slices, without

SIMILAR, LONG = 0.8, 96
#: Most bits of the maps of keys that are met twice and of lines to verify (64 MB).
MAP_BITS = 1 << 29
#: Characters of scripts written without spaces; each counts as a word.
_NO_SPACES = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: First bytes of characters of three bytes and more, which those are.
_LONG = bytes(range(0xE0, 0x100))
#: Lower-cases A-Z, digits to 0; newlines stay; every other ASCII character that is no letter becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if 97 <= c <= 122 or c > 127 or c == 10 else 32 for c in range(256))


def normalised(text: str) -> list[bytes | None]:
    """Each line as its words, or what it holds if that is other characters only; None if it is empty."""
    lower = text.lower()
    data = lower.encode("utf-8", "surrogatepass")
    if len(data.translate(None, _LONG)) < len(data):
        data = _NO_SPACES.sub(r" \g<0> ", lower).encode("utf-8", "surrogatepass")
    b = np.frombuffer(data.translate(_TABLE), np.uint8)
    kept = b != 32
    kept[1:] |= b[:-1] > 32  # the first space after a word
    out: list[bytes | None] = [line or None for line in b[kept].tobytes().replace(b" \n", b"\n").rstrip(b" ").split(b"\n")]
    if None in out:
        out = [form or b" ".join(line.encode("utf-8", "surrogatepass").split()) or None for form, line in zip(out, text.split("\n"), strict=True)]
    return out


def line_ids(text: str) -> list[int | None]:
    """The signed id of each line, None if it is empty."""
    return [None if form is None else _digest(form) for form in normalised(text)]


def _digest(form: bytes) -> int:
    h = xxh3_64_intdigest(form)
    return h - (h >> 63 << 64)


def _signed(digests: list[int]) -> pa.Array:
    return pa.array(np.array(digests, np.uint64).view(np.int64))


_BASE, _RUN = 0x9E3779B97F4A7C15, 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_RUN - 1, base, np.uint64)]))


_POWERS: list[np.ndarray] = []  # of the base and of its inverse, made at first use in a worker


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of single-spaced text: polynomial of the bytes, then mixed. Long text goes in runs."""
    if len(data) > _RUN:
        cut = data.rfind(b" ", 0, _RUN)
        if cut < 0:
            cut = data.find(b" ")
            first = np.array([_digest(data if cut < 0 else data[:cut])], np.int64).view(np.uint64)
            return first if cut < 0 else np.concatenate([first, word_hashes(data[cut + 1 :])])
        parts = []
        while len(data) > _RUN and (cut := data.rfind(b" ", 0, _RUN)) >= 0:
            parts.append(word_hashes(data[:cut]))
            data = data[cut + 1 :]
        return np.concatenate([*parts, word_hashes(data)])
    if not _POWERS:
        _POWERS.extend([_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))])
    b = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * _POWERS[0][: len(b)], out=sums[1:])
        ends = np.append(np.flatnonzero(b == 32), len(b))
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = (sums[ends] - sums[starts]) * _POWERS[1][starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return h ^ (h >> np.uint64(32))


def _shares(lines: list[bytes]) -> Iterator[list[bytes]]:
    """The lines in groups of a bounded size; a longer line is one alone."""
    group: list[bytes] = []
    size = 0
    for line in lines:
        if group and (size + len(line) >= _RUN or len(group) == 60_000):
            yield group
            group, size = [], 0
        group.append(line)
        size += len(line) + 1
    if group:
        yield group


def prefix(n: np.ndarray) -> np.ndarray:
    """How many of the first pairs of neighbouring words, in any one order, of a line of n words hold one of every similar line's first ones.

    An edit changes at most two pairs of the longer line, so similar lines share its n - 1 pairs but twice the ``edits``; the
    fewest such is at n words or, for a shorter line, at the next multiple of five.
    """
    shared, longer = n - 1 - 2 * edits(n), -(-n // 5) * 5
    return n - np.where(4 * longer <= 5 * n, np.minimum(shared, longer - 1 - 2 * edits(longer)), shared)


#: Bits of a word's hash by which words are counted, and of the part of a pair's hash that one task looks through for repeated ones.
COUNTED, DEALT = 22, 12
_LOW = [np.uint64((1 << k) - 1) for k in range(65)]


def line_keys(w: np.ndarray, n: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(line, key)``: keys of 48 bits of the rarest ``prefix`` pairs of words of each line of four words and more.

    ``w`` has the hashes of the words of at most 65,535 lines of n words each; ``rarity`` orders words by how often they are met.
    Of pairs that a line has several times each is one of its own. Lines that are similar share a key, whatever the order.
    """
    of = np.repeat(np.arange(len(n)), n)
    two = np.flatnonzero((of[1:] == of[:-1]) & (n >= 4)[of[1:]])
    a, b = w[two], w[two + 1]
    rank = (rarity[a >> np.uint32(32 - COUNTED)].astype(np.uint64) + rarity[b >> np.uint32(32 - COUNTED)]) >> np.uint64(1)
    held = np.sort(of[two].astype(np.uint64) << np.uint64(48) | rank << np.uint64(40) | _mixed(a.astype(np.uint64) << np.uint64(32) | b) >> np.uint64(24))
    line, every = (held >> np.uint64(48)).astype(np.int64), np.arange(len(held))
    since = lambda new: every - np.maximum.accumulate(np.where(new, every, 0)) if len(every) else every
    taken = since(np.diff(line, prepend=-1) != 0) < prefix(n)[line]
    times = since(np.diff(held, prepend=held[:1] + np.uint64(1)) != 0)[taken].astype(np.uint64)
    held = held[taken] & _LOW[48]
    again = np.flatnonzero(times)
    held[again] = held[again] & ~_LOW[40] | _mixed(held[again] << np.uint64(16) ^ times[again] * _MIX[1]) >> np.uint64(24)
    return line[taken], held


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * _MIX[0]
        x = (x ^ x >> np.uint64(29)) * _MIX[1]
        return x ^ x >> np.uint64(32)


def sketches(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of normalised lines: numbers of words, parities of their words by hash class, hashes of all their words, and where each line's end there.

    Lines of ``LONG`` words have 256 classes in four longs, others 128 in the first two: the halves of the former xored.
    """
    sizes, parity = np.zeros(len(lines), np.int64), np.zeros((len(lines), 4), np.uint64)
    words, done = [np.zeros(0, np.uint32)], 0
    for group in _shares(lines):
        h = word_hashes(b" ".join(group))
        n = np.fromiter((line.count(b" ") + 1 for line in group), np.int64, len(group))
        starts = np.cumsum(n) - n
        bit, part = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(3)
        here = slice(done, done + len(group))
        sizes[here] = n
        for k in range(4):
            parity[here, k] = np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), starts)
        short = done + np.flatnonzero(n < LONG)
        parity[short, :2] ^= parity[short, 2:]
        parity[short, 2:] = 0
        words.append((h >> np.uint64(32)).astype(np.uint32))
        done += len(group)
    return sizes, parity.view(np.int64), np.concatenate(words), np.cumsum(sizes)


_PARITY = [f"p{k}" for k in range(4)]


def line_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, id, places, n, p0..., words)``: the distinct lines of each text with where they stand.

    ``row`` is a hash of the whole text. Numbers of words, parities and the words' hashes (four bytes each) are null where the
    task has given them for an equal line before.
    """
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # digests, unsigned as those of ``found``
        for batch in slices(batches, 250):
            sizes_of, ids, places, fresh, forms = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found: dict[int, list[int]] = {}
                for j, form in enumerate(normalised(text)):
                    if form is None:
                        continue
                    h = xxh3_64_intdigest(form)
                    if h in found:
                        found[h].append(j)
                        continue
                    if h not in sent:
                        sent.add(h)
                        fresh.append(len(ids) + len(found))
                        forms.append(form)
                    found[h] = [j]
                sizes_of.append(len(found))
                ids += found
                places += found.values()
            sizes, parity, hashes, stops = sketches(forms)
            new = np.full(len(ids), -1)
            new[fresh] = np.arange(len(fresh))
            old = new < 0
            spread = lambda x: pa.array(x[new] if len(x) else np.zeros(len(ids), np.int64), mask=old)  # noqa: B023, E731
            of = pa.array(np.repeat(np.arange(len(sizes_of)), sizes_of))
            ends = np.cumsum(np.fromiter(map(len, places), np.int32, len(places)), dtype=np.int32)
            held = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(np.fromiter(chain.from_iterable(places), np.int32, int(ends[-1]) if len(ends) else 0)))
            words = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(np.append(0, 4 * stops).astype(np.int32)), pa.py_buffer(hashes)]).take(pa.array(new, mask=old))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), _signed(ids), held, spread(sizes), *[spread(parity[:, k]) for k in range(4)], words], names=["doc_id", "row", "id", "places", "n", *_PARITY, "words"])
            if len(sent) > 300_000:
                sent.clear()

    longs = [T.StructField(c, T.LongType()) for c in ("n", *_PARITY)]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType())), *longs, T.StructField("words", T.BinaryType())]))


def _hashes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of a column without nulls, one after the other, and each line's number of words."""
    stops = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    held = np.frombuffer(column.buffers()[2], np.uint8)[stops[0] : stops[-1]].view(np.uint32) if stops[-1] > stops[0] else np.zeros(0, np.uint32)
    return held, np.diff(stops).astype(np.int64) // 4


def _rarity(lines: DataFrame) -> np.ndarray:
    """For each hash class of words a byte that grows with how often its words are met in ``lines(words)``."""

    wide = 1 << (COUNTED - 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << COUNTED, np.int64)
        for batch in slices(batches):
            classes, times = np.unique(_hashes(batch.column(0))[0] >> np.uint32(32 - COUNTED), return_counts=True)
            count[classes] += times
        for part in np.flatnonzero(count.reshape(-1, wide).any(1)).tolist():
            here = count[part * wide : (part + 1) * wide]
            met = np.flatnonzero(here)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([met.astype(np.uint16).tobytes()], pa.binary()), pa.array([here[met].tobytes()], pa.binary())], names=["part", "class", "times"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, classes, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, np.zeros(wide, np.int64))[np.frombuffer(classes, np.uint16)] += np.frombuffer(times, np.int64)
        for part, times in held.items():
            ranks = np.where(times < 64, times, np.minimum(255, 64 + 8 * np.log2(np.maximum(times, 64) / 64))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], names=["part", "ranks"])

    found = lines.select("words").mapInArrow(run, "part int, class binary, times binary").repartition("part").mapInArrow(summed, "part int, ranks binary").toArrow()
    out = np.zeros((1 << 8, wide), np.uint8)
    for part, ranks in zip(found["part"].to_pylist(), found["ranks"], strict=True):
        out[part] = np.frombuffer(ranks.as_buffer(), np.uint8)
    return out.ravel()


def _repeated(lines: DataFrame, rarity, size: int) -> bytes:
    """A map of ``size`` bits with those set at whose keys' hashes two keys of lines meet."""
    bits = size.bit_length() - 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def parts() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(waiting))
            waiting.clear()
            starts = np.searchsorted(keys, np.arange((1 << DEALT) + 1, dtype=np.uint64) << np.uint64(40 - DEALT))
            there = np.flatnonzero(np.diff(starts))
            stops = np.append(starts[there], len(keys)).astype(np.int32) * 4
            held = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(stops), pa.py_buffer((keys & _LOW[40 - DEALT]).astype(np.uint32))])
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), held], names=["part", "keys"])

        for batch in slices(batches):
            waiting.append(line_keys(*_hashes(batch.column(0)), rarity.value)[1] & _LOW[40])
            if sum(map(len, waiting)) > 2_000_000:
                yield parts()
        if waiting:
            yield parts()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(part, []).append(np.frombuffer(keys.as_buffer(), np.uint32))
        for part in list(held):
            keys = np.sort(np.concatenate(held.pop(part)))
            twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint32(40 - bits)
            out = np.zeros(1 << (bits - DEALT), np.uint8)
            out[twice] = 1
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    found = lines.select("words").mapInArrow(dealt, "part int, keys binary").repartition("part").mapInArrow(met, "part int, bits binary").toArrow()
    out = np.zeros((1 << DEALT, size >> (DEALT + 3)), np.uint8)
    for part, held in zip(found["part"].to_pylist(), found["bits"], strict=True):
        out[part] = np.frombuffer(held.as_buffer(), np.uint8)
    return out.tobytes()


def block_rows(rows: DataFrame) -> DataFrame:
    """``(id, p0..., blocks)``: the lines of ``line_rows`` that may have similar ones, each with its keys that other lines have too."""
    context, lines = rows.sparkSession.sparkContext, rows.where("n >= 4")
    size = min(MAP_BITS, max(1 << 16, 1 << (4 * (lines.agg(F.sum("n")).first()[0] or 0)).bit_length()))
    rarity = context.broadcast(_rarity(lines))
    shared = context.broadcast(_repeated(lines, rarity, size))
    shift = np.uint64(41 - size.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches):
            w, n = _hashes(batch.column(5))
            line, key = line_keys(w, n, rarity.value)
            at = (key & _LOW[40]) >> shift
            kept = bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0
            line, key = line[kept], key[kept]
            blocks = (key << np.uint64(16) | np.minimum(n, _MANY).astype(np.uint64)[line]).view(np.int64)
            there = np.flatnonzero(np.bincount(line, minlength=len(n)))
            stops = np.append(np.searchsorted(line, there), len(line)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(there)) for c in batch.columns[:5]], pa.ListArray.from_arrays(pa.array(stops), pa.array(blocks))], names=["id", *_PARITY, "blocks"])

    return lines.select("id", *_PARITY, "words").mapInArrow(run, ", ".join(f"{c} long" for c in ("id", *_PARITY)) + ", blocks array<long>")


def edits(words: np.ndarray) -> np.ndarray:
    """The most edits between similar lines of which the longer has so many words."""
    return np.floor((1 - SIMILAR) * words + 1e-9).astype(np.int64)


#: Numbers of words from here on share their last 16 bits of a block row.
_MANY = (1 << 16) - 1


def _fits(n: np.ndarray, parity: np.ndarray, other_n: np.ndarray, other_parity: np.ndarray) -> np.ndarray:
    """Whether lines may be similar, by their numbers of words and their parities.

    An edit that puts a word in place of another changes two parities, one that makes a line longer or shorter only one.
    """
    longer, apart = np.maximum(n, other_n), parity ^ other_parity
    room = edits(longer)
    every = np.bitwise_count(apart).sum(-1)
    folded = np.bitwise_count(apart[..., :2] ^ apart[..., 2:]).sum(-1)
    bits = np.where(np.minimum(n, other_n) >= LONG, every, folded)
    gap = np.abs(n - other_n)
    return (longer >= _MANY) | ((bits <= 2 * room - gap) & (gap <= room))


#: Lines of blocks of which all pairs are looked at together.
SMALL = 64


def _walk_small(starts: np.ndarray, size: int, n: np.ndarray, parity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(representatives, lines)`` of blocks of one small size, all at once."""
    at = starts[:, None] + np.arange(size)
    left, right = np.triu_indices(size, 1)
    fits = np.zeros((len(at), size, size), bool)
    fits[:, left, right] = _fits(n[at[:, left]], parity[at[:, left]], n[at[:, right]], parity[at[:, right]])
    other = np.zeros(at.shape, bool)  # lines that have a representative
    for p in range(size - 1):
        other[:, p + 1 :] |= fits[:, p, p + 1 :] & ~other[:, p, None]
    block, i, j = np.nonzero(fits)
    first = ~other[block, i]
    met = first | ~other[block, j]
    block, i, j, first = block[met], i[met], j[met], first[met]
    return at[block, np.where(first, i, j)], at[block, np.where(first, j, i)]


def _walk(n: np.ndarray, parity: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(representatives, lines, all representatives)`` of a block sorted by n; the first ``known`` lines are some already."""
    low = np.searchsorted(n, np.ceil(SIMILAR * n - 1e-9))
    high = np.where(n >= _MANY, len(n), np.searchsorted(n, np.floor(n / SIMILAR + 1e-9), "right"))
    other, rep, tops, lows = np.zeros(len(n), bool), np.zeros(len(n), bool), [], []
    rep[:known] = True
    for i in range(len(n)):
        if other[i]:
            continue
        rep[i] = True
        a, b = int(max(low[i], 0)), int(high[i])
        near = np.flatnonzero(~rep[a:b]) + a
        near = near[_fits(n[near], parity[near], n[i], parity[i])]
        if len(near):
            lows.append(near)
            tops.append(np.full(len(near), i))
            other[near] = True
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *tops]), np.concatenate([none, *lows]), np.flatnonzero(rep)


def representatives(rows: DataFrame, ranged: bool = True, chunk: int = 300_000) -> DataFrame:
    """``(block, task, a, b, p0...)`` of ``rows(block, id, p0...)``, whose block holds the line's number of words in its last 16 bits.

    A row is a line b of a block with its representative a; block and parities are those of b. If ``ranged``, a block may
    lie in several tasks: rows of null b are the representatives of the first and the last block of each task. A task holds
    about ``chunk`` rows at a time; of a block of more, the representatives go on, and rows of null b have them for each
    chunk. ``task`` tells tasks and their chunks apart.
    """
    dealt = rows.repartitionByRange(F.col("block")) if ranged else rows.repartition(F.shiftright("block", 16))
    cut = dealt.select("block", "id", *_PARITY).sortWithinPartitions("block", "id")
    names = ["block", "task", "a", "b", *_PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        known, first, chunks = 0, True, 0  # representatives at the start of what waits; whether no block is done yet; chunks done

        def found(last: bool) -> pa.RecordBatch:
            nonlocal known, first, chunks
            part = np.concatenate(waiting)
            new = np.ones(len(part), bool)  # equal lines come from several tasks
            new[1:] = (part[1:, 0] != part[:-1, 0]) | (part[1:, 1] != part[:-1, 1])
            new[:known] = True
            part = part[new]
            key = part[:, 0] >> 16
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(part))
            rest = part[:0]
            if not last and ends[-1] - starts[-1] < chunk:  # the last block may go on
                rest, part, starts, ends = part[starts[-1] :], part[: starts[-1]], starts[:-1], ends[:-1]
            n, parity, size = part[:, 0] & _MANY, part[:, 2:].view(np.uint64), ends - starts
            tops, lows, reps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], None
            for k in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
                some, step = starts[(size == k) & (starts >= known)], max(1, 200_000 // (k * k))
                for i in range(0, len(some), step):
                    t, w = _walk_small(some[i : i + step], k, n, parity)
                    tops.append(t)
                    lows.append(w)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if size.max(initial=0) > SMALL or known else ():
                if e - s > SMALL or s < known:
                    t, w, reps = _walk(n[s:e], parity[s:e], known if s == 0 else 0)
                    tops.append(s + t)
                    lows.append(s + w)
                    reps = s + reps
            top, low = np.concatenate(tops), np.concatenate(lows)
            border = [np.zeros(0, np.int64)]
            if ranged and len(starts):
                for x in ({0} if first or known else set()) | ({len(starts) - 1} if last or not len(rest) else set()):
                    at = np.arange(starts[x], ends[x])
                    border.append(at[~np.isin(at, low)])
                first = False
            edge = np.concatenate(border)
            of, none = np.concatenate([low, edge]), np.repeat([False, True], [len(low), len(edge)])
            a, b = part[np.concatenate([top, edge]), 1], part[of, 1]
            waiting[:], known = ([rest], 0) if last or len(rest) or not len(starts) else ([part[reps]], len(reps))
            chunks += 1
            return pa.RecordBatch.from_arrays([pa.array(part[of, 0]), pa.array(np.full(len(of), task << 32 | chunks)), pa.array(a), pa.array(b, mask=none), *[pa.array(part[of, 2 + k]) for k in range(4)]], names=names)

        for batch in batches:
            waiting.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            if sum(map(len, waiting)) - known >= chunk:
                yield found(False)
        if sum(map(len, waiting)):
            yield found(True)

    return cut.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _bitmap(ids: DataFrame) -> bytes:
    """A map with the bits of the ids set, of about 32 bits an id up to ``MAP_BITS``; its words are combined in Spark."""
    size = min(MAP_BITS, max(1 << 16, 1 << (32 * ids.count()).bit_length()))
    bit = F.col("id").bitwiseAND(size - 1)
    words = ids.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()
    out = np.zeros(size // 64, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.tobytes()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, line)``: the normalised text of the lines of ``wanted(id)``."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    rows = docs.where("doc_id is not null and text is not null").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = shared.value, set()
        last = 8 * len(bits) - 1
        for batch in slices(batches):
            out: dict[int, bytes] = {}
            for text in batch.column(0).to_pylist():
                for form in normalised(text):
                    if form is not None:
                        h = xxh3_64_intdigest(form)
                        at = h & last
                        if bits[at >> 3] >> (at & 7) & 1 and h not in sent:
                            sent.add(h)
                            out[h] = form
            if len(sent) > 300_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays([_signed(list(out)), pa.array([v.decode("utf-8", "surrogatepass") for v in out.values()], pa.string())], names=["id", "line"])

    return rows.mapInArrow(run, "id long, line string").join(wanted.select(F.col("id").alias("w")), F.col("id") == F.col("w"), "left_semi").groupBy("id").agg(F.first("line").alias("line"))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two sequences, bit-parallel over what is left between a common start and a common end."""
    lo, ea, eb = 0, len(a), len(b)
    while lo < min(ea, eb) and a[lo] == b[lo]:
        lo += 1
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[lo:ea], b[lo:eb]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for w in b:
        eq = places.get(w, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(h | plus) & full, plus & h
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(x | up) & full, up & x
    return distance


def similar(a: str, b: str) -> bool:
    x, y = a.split(" "), b.split(" ")
    room = (1 - SIMILAR) * max(len(x), len(y)) + 1e-9
    if abs(len(x) - len(y)) > room:
        return False
    u, v = set(x), set(y)
    if len(u.difference(v)) > room or len(v.difference(u)) > room:  # each of these words takes an edit of its own
        return False
    return (len(x) == len(y) and sum(map(ne, x, y)) <= room) or edit_distance(x, y) <= room


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` with whether their lines are similar."""
    joined = pairs.join(texts.select(F.col("id").alias("id_a"), F.col("line").alias("line_a")), F.col("a") == F.col("id_a")).join(
        texts.select(F.col("id").alias("id_b"), F.col("line").alias("line_b")), F.col("b") == F.col("id_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = [similar(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return joined.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long, ok boolean")


#: Lines of a block that one task compares with as many others, where not all of a block's are of one group.
SIDE = 8192


#: Classes by which the words of lines over so many words are counted.
CLASSES, COUNTS_FROM = 256, 24


def word_counts(texts: DataFrame) -> DataFrame:
    """``(counted, counts)``: of the longer ones of ``texts(id, line)`` how many words they have of each class, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, _, hashes, _ = sketches([line.encode("utf-8", "surrogatepass") for line in batch.column(1).to_pylist()])
            of = np.repeat(np.arange(len(sizes)), sizes)
            counts = np.minimum(np.bincount(of * CLASSES + (hashes & np.uint32(CLASSES - 1)), minlength=len(sizes) * CLASSES), 255).astype(np.uint8).reshape(-1, CLASSES)
            told = np.flatnonzero(sizes >= COUNTS_FROM)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(told)), pa.array([counts[i].tobytes() for i in told], pa.binary())], names=["counted", "counts"])

    return texts.select("id", "line").mapInArrow(run, "counted long, counts binary")


def _apart(group: np.ndarray, n: np.ndarray, parity: np.ndarray, side: np.ndarray, at_counts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(line, line)``: all pairs of lines sorted by n that may be similar and are of different groups, and of different sides if there are two.

    ``at_counts`` has the place of a line's ``counts``, or -1: an edit moves two of them by one at most.
    """
    groups, at, times = np.unique(group, return_inverse=True, return_counts=True)
    main = at == times.argmax()  # no two of these are a pair
    low = np.searchsorted(n, np.ceil(SIMILAR * n - 1e-9))
    high = np.where(n >= _MANY, len(n), np.searchsorted(n, np.floor(n / SIMILAR + 1e-9), "right"))
    two, every = side.min() < side.max(), np.flatnonzero(~main)
    lefts, rights, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while i < len(every):
        start = low[every[i]]
        step = max(1, 200_000 // max(1, int(high[every[min(len(every), i + 512) - 1]] - start)))
        left = every[i : i + min(step, 512)]
        right = np.arange(start, high[left].max())
        ok = (group[left][:, None] != group[right]) & (main[right] | (left[:, None] < right))
        if two:
            ok &= side[left][:, None] != side[right]
        x, y = np.nonzero(ok)
        x, y = left[x], right[y]
        ok = _fits(n[x], parity[x], n[y], parity[y])
        x, y = x[ok], y[ok]
        longer, ok = np.maximum(n[x], n[y]), np.ones(len(x), bool)
        told = np.flatnonzero((at_counts[x] >= 0) & (at_counts[y] >= 0) & (longer < _MANY))
        for j in range(0, len(told), 10_000):
            some = told[j : j + 10_000]
            moved = np.abs(counts[at_counts[x[some]]].astype(np.int16) - counts[at_counts[y[some]]]).sum(1, dtype=np.int64)
            ok[some] = moved <= 2 * edits(longer[some]) - np.abs(n[x[some]] - n[y[some]])
        lefts.append(x[ok])
        rights.append(y[ok])
        i += len(left)
    return np.concatenate(lefts), np.concatenate(rights)


def across(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """``(a, b)``: of ``lines(key, group, id, n, p0...)`` all pairs of one key and different groups that may be similar; ``counts`` by ``word_counts``.

    Lines know all their keys that hold several groups, so a pair comes from the first one that it shares, once.
    """
    wide = lines.groupBy(F.col("key").alias("of")).agg(F.min("group").alias("low"), F.max("group").alias("high"), F.ceil(F.count("*") / SIDE).cast("int").alias("sides")).where("low <> high")
    held = lines.join(wide, F.col("key") == F.col("of")).dropDuplicates(["key", "id"])
    keys = held.groupBy(F.col("id").alias("keyed")).agg(F.collect_set("key").alias("keys"))
    held = held.join(keys, F.col("id") == F.col("keyed")).withColumn("side", F.expr("cast(pmod(xxhash64(id), sides) as int)"))
    told = held.where(F.col("n") >= COUNTS_FROM).join(counts, F.col("id") == F.col("counted"), "left").drop("counted")
    held = held.where(F.col("n") < COUNTS_FROM).withColumn("counts", F.lit(None).cast("binary")).unionByName(told)
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    cells = held.select("key", "group", "id", "n", *_PARITY, "counts", "keys", "side", other).withColumns({"left": F.least("side", "other"), "right": F.greatest("side", "other")})
    names = ["key", "left", "right", "side", "group", "id", "n", *_PARITY]
    cells = cells.repartition("key", "left", "right").select(*[F.col(c).cast("long") for c in names], "counts", "keys").sortWithinPartitions("key", "left", "right", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, counts, keys = np.zeros((0, len(names) + 3), np.int64), np.zeros((0, CLASSES), np.uint8), np.zeros(0, np.int64)

        def found(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            cell = part[:, :3]
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)])[: len(part)])
            out, size = [], 0
            for s, e in zip(starts, np.append(starts[1:], len(part)), strict=False):
                x, y = _apart(part[s:e, 4], part[s:e, 6], part[s:e, 7:11].view(np.uint64), part[s:e, 3], part[s:e, 11], counts)
                if len(x):
                    of = {i: set(keys[part[s + i, 12] : part[s + i, 13]].tolist()) for i in {*x.tolist(), *y.tolist()}}
                    first = np.array([min(of[i] & of[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]) == part[s, 0]
                    x, y = x[first], y[first]
                if len(x):
                    a, b = part[s + x, 5], part[s + y, 5]
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                    size += len(x)
                if size > 100_000 or (out and e == len(part)):
                    met = np.concatenate(out, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(met[0]), pa.array(met[1])], names=["a", "b"])
                    out, size = [], 0

        for batch in batches:
            there = batch.column(len(names)).is_valid().to_numpy(zero_copy_only=False)
            place = np.where(there, len(counts) + np.cumsum(there) - 1, -1)
            if there.any():
                counts = np.concatenate([counts, np.frombuffer(b"".join(batch.column(len(names)).drop_null().to_pylist()), np.uint8).reshape(-1, CLASSES)])
            stops = len(keys) + np.cumsum(pc.list_value_length(batch.column(len(names) + 1)).to_numpy())
            starts = np.append(len(keys), stops[:-1])
            keys = np.concatenate([keys, batch.column(len(names) + 1).flatten().to_numpy()])
            rest = np.concatenate([rest, np.stack([*[c.to_numpy() for c in batch.columns[: len(names)]], place, starts, stops], axis=1)])
            last = np.flatnonzero((rest[:, :3] != rest[-1, :3]).any(1)) if len(rest) else []
            done = last[-1] + 1 if len(last) else 0
            yield from found(rest[:done])
            rest = rest[done:].copy()
            told = np.flatnonzero(rest[:, 11] >= 0)
            counts, rest[told, 11] = counts[rest[told, 11]], np.arange(len(told))
            gone = rest[0, 12] if len(rest) else len(keys)
            keys = keys[gone:]
            rest[:, 12:] -= gone
        yield from found(rest)

    return cells.mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, rows: DataFrame, scratch: Scratch, read_once: str = "") -> DataFrame:
    """``(a, b)``: each line of ``rows``, as ``line_rows`` gives them, that is similar to another, with the smallest id of its group.

    ``read_once``: the scratch table that ``rows`` are, if it may go once their keys are written.
    """
    key = F.shiftright("block", 16)
    ordered = lambda met: met.where("b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    keys = scratch.keep(block_rows(rows), "keys", texts=True)
    if read_once:
        scratch.drop(read_once)
    met = scratch.keep(representatives(keys.select(F.explode("blocks").alias("block"), "id", *_PARITY)), "met")
    scratch.drop("keys")
    ends = met.where("b is null").select(key.alias("key"), "task", "block", F.col("a").alias("id"), *_PARITY)
    wide = ends.groupBy(F.col("key").alias("wide")).agg(F.min("task").alias("low"), F.max("task").alias("high")).where("low <> high")
    # representatives of blocks that reach over a border of tasks or chunks
    ends = scratch.keep(ends.join(wide, F.col("key") == F.col("wide")).select("block", "id", *_PARITY).distinct(), "ends")
    border = scratch.keep(representatives(ends, ranged=False), "border")
    first = scratch.keep(ordered(met.unionByName(border)), "pairs")
    ids = first.select(F.col("a").alias("id")).unionByName(first.select(F.col("b").alias("id"))).unionByName(ends.select("id")).distinct()
    texts = scratch.keep(_texts(docs, scratch.keep(ids, "wanted")), "texts", texts=True)
    similar_of = lambda p, name: scratch.keep(_compared(p, texts).where("ok").select("a", "b"), name, texts=True)
    labels = scratch.keep(connected_components(similar_of(first, "similar"), scratch, "cc"), "first-labels")
    # Within a block only lines that have a representative, and all of a block that reaches over a border, haven't met all others.
    # Those that are in different groups by now meet each other, so each two similar lines end in one group.
    lines = met.where("b is not null").select("block", F.col("b").alias("id"), *_PARITY).unionByName(ends).withColumn("key", key)
    lines = lines.join(labels, F.col("id") == F.col("node"), "left").select("key", F.coalesce("component", "id").alias("group"), "id", F.col("block").bitwiseAND(_MANY).alias("n"), *_PARITY)
    more = scratch.keep(across(scratch.keep(lines, "lines-of-blocks"), word_counts(texts)).join(first, ["a", "b"], "left_anti"), "more-pairs")
    if more.isEmpty():
        return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    group = lambda c: labels.select(F.col("node").alias(f"{c}-node"), F.col("component").alias(f"{c}-group"))
    joined = similar_of(more, "more-similar").join(group("a"), F.col("a") == F.col("a-node"), "left").join(group("b"), F.col("b") == F.col("b-node"), "left")
    edges = scratch.keep(joined.select(F.coalesce("a-group", "a").alias("a"), F.coalesce("b-group", "b").alias("b")).distinct(), "edges")
    merged = scratch.keep(connected_components(edges, scratch, "merged-cc"), "merged")
    moved = labels.join(merged.select(F.col("node").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left")
    lone = merged.join(labels.select(F.col("node").alias("held")), F.col("node") == F.col("held"), "left_anti")
    return moved.select(F.col("node").alias("a"), F.coalesce("new", "component").alias("b")).unionByName(lone.select(F.col("node").alias("a"), F.col("component").alias("b")))


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, row, marks)``: for each text the lines that belong to a group of several occurrences or lines:
    place, group, and whether the document is the one that keeps it."""
    lines = scratch.keep(line_rows(docs), "lines", texts=True)
    rows = scratch.keep(lines.select("doc_id", "row", "id", "places"), "places")
    labels = scratch.keep(links(docs, lines, scratch, "lines").toDF("node", "component"), "labels")
    scratch.leave("places", "labels")
    distinct = rows.groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.sum(F.size("places")).alias("times"))
    held = distinct.join(labels, F.col("id") == F.col("node"), "left").where("times > 1 or component is not null").select("id", "first_doc", F.coalesce("component", "id").alias("group"))
    held = scratch.keep(held, "held")
    owner = scratch.keep(held.groupBy(F.col("group").alias("owned")).agg(F.min("first_doc").alias("owner")), "owner")  # so that Spark can split a large group in the join
    marked = scratch.keep(held.join(owner, F.col("group") == F.col("owned")).select(F.col("id").alias("mark_id"), "group", "owner"), "marked")
    mark = F.struct("places", "group", (F.col("owner") == F.col("doc_id")).alias("owns"))
    found = rows.select("doc_id", "row", "id", "places").join(marked, F.col("id") == F.col("mark_id"))
    marks = scratch.keep(found.groupBy("doc_id", "row").agg(F.collect_set(mark).alias("marks")), "marks")
    scratch.leave("marks")
    return marks


def clean_text(text: str, marks: list[tuple[list[int], int, bool]]) -> tuple[str, int, int]:
    """``(text, lines, those removed)``; ``marks`` has places of lines, their group, and whether this document keeps it."""
    gone: set[int] = set()
    first: dict[int, int] = {}
    for places, group, owns in marks:
        gone.update(places)
        if owns:
            first[group] = min(first.get(group, places[0]), *places)
    gone.difference_update(first.values())
    if not gone:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone)


def _own_marks(text: str) -> list[tuple[list[int], int, bool]]:
    """Marks of a text by itself."""
    found: dict[int, list[int]] = {}
    for i, h in enumerate(line_ids(text)):
        if h is not None:
            found.setdefault(h, []).append(i)
    return [(places, h, True) for h, places in found.items()]


def _marks(column: pa.ListArray) -> list[list[tuple[list[int], int, bool]] | None]:
    """The marks of each text, None where there are none."""
    flat = column.flatten()
    held = list(zip(*(flat.field(name).to_pylist() for name in ("places", "group", "owns")), strict=True))
    there = column.is_valid().to_pylist()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [held[a:b] if is_there else None for is_there, a, b in zip(there, [0, *ends], ends, strict=False)]


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with its text cleaned, and last columns n_lines, n_removed; input columns of these names are replaced."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select(*without(docs, "n_lines", "n_removed"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")
    marks = groups(docs, scratch).select(F.col("doc_id").alias("marked_doc"), F.col("row").alias("marked_row"), "marks")
    plain = docs.toDF(*names)
    joined = plain.join(marks, (F.col(names[key]) == F.col("marked_doc")) & (F.xxhash64(names[at]) == F.col("marked_row")), "left").select(*names, "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, gone = [], [], []
            for text, has_id, found in zip(batch.column(at).to_pylist(), batch.column(key).is_valid().to_pylist(), _marks(batch.column(batch.num_columns - 1)), strict=True):
                if found is None:
                    found = [] if has_id or not text else _own_marks(text)
                t, n, g = clean_text(text, found) if text else (text, 0, 0)
                texts.append(t)
                counts.append(n)
                gone.append(g)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_removed"])

    out = joined.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
    return out.toDF(*docs.columns, "n_lines", "n_removed")
