"""Periodic runs of words by online dyadic square catching, and texts with each run cut down to its first period.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), of at least
max(``shortest``, ``times`` * q) words, that no neighbouring word extends.

Catchers: every completed block of w = 8, 16, 32, ... words (at multiples of w) holds a catcher. It waits for the
suffix of w words to equal its block: w to 2w - 1 words after its own start, so each appended word is compared with one
catcher a level; blocks of 8 also wait from 1 word on. A run of period q has, with w the power of two next below q (8 at
least), a whole block of w words and a copy of it q words later, so every run is caught when that copy is complete.
Suffixes are compared by prefix sums of word hashes, a level at a time for all words appended together. Squares of one
period that touch merge into stretches; at the end a stretch grows by bisection over the same sums to its run. A
run's words are compared themselves at last; should hashes have erred, the runs of the periods caught are found word by word.

Scale: a row's work is n log n array steps for n words, nothing is shuffled, and memory goes with one text: about 16
bytes a word besides the words. Short texts go through one catcher together, about ``together`` words at a time.

Edge cases: a null text stays null and has no run, an empty one stays empty. Words are what ASCII blanks separate; a
text without runs comes out with its words joined by one space. Rows of equal or null ``doc_id`` are judged one by one.
An empty table gives an empty result. Extra columns pass through; input columns named like its own (n_words, runs, in
any case) are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docquarry.llm._shared import slices, without

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_LEAST = 8
_BASE = 0x9E3779B97F4A7C15


class SquareCatcher:
    """Finds the runs of words that come in any portions."""

    def __init__(self, shortest: int = 24, times: int = 3, longest: int | None = None):
        """``longest``: no run has more words, if known."""
        if shortest < 3 * _LEAST or times < 3:
            raise ValueError("runs are caught from 24 words and three periods on")
        self.shortest, self.times, self.longest = shortest, times, longest
        self.words: list[bytes] = []
        self.powers = np.ones(1, np.uint64)
        self.sums = np.zeros(1, np.uint64)
        self.caught: list[np.ndarray] = []

    def append(self, words: Sequence[bytes]) -> None:
        """Takes the next words; all catchers of a level see them together."""
        old, n = len(self.words), len(self.words) + len(words)
        self.words.extend(words)
        if n >= len(self.sums):
            more = max(n + 1 - len(self.sums), len(self.sums) if old else 0)
            grown = self.powers[-1] * np.cumprod(np.full(more, _BASE, np.uint64))
            self.powers = np.concatenate([self.powers, grown])
            self.sums = np.concatenate([self.sums, np.zeros(more, np.uint64)])
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        self.sums[old + 1 : n + 1] = self.sums[old] + np.cumsum(h * self.powers[old:n])
        first = max(0, old - 2 * _LEAST) // _LEAST * _LEAST
        s = np.arange(first, n - _LEAST, _LEAST)
        s, q = (x.ravel() for x in np.broadcast_arrays(s[:, None], np.arange(1, _LEAST)))
        seen = (s + q + _LEAST > old) & (s + q + _LEAST <= n)
        self._catch(s[seen], q[seen], _LEAST)
        w = _LEAST
        while 2 * w <= n and (self.longest is None or self.times * w <= self.longest):
            j = np.arange(max(w, old - w + 1), n - w + 1)
            q = w + (j & (w - 1))
            self._catch(j - q, q, w)
            w *= 2

    def _same(self, i: np.ndarray, q: np.ndarray, m: np.ndarray | int) -> np.ndarray:
        """Whether the m words from i on equal those from i + q on."""
        return (self.sums[i + m] - self.sums[i]) * self.powers[q] == self.sums[i + q + m] - self.sums[i + q]

    def _catch(self, s: np.ndarray, q: np.ndarray, w: int) -> None:
        hit = np.flatnonzero(self._same(s, q, w))
        if len(hit):
            self.caught.append(_merged(np.stack([q[hit], s[hit], s[hit] + w])))

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of the runs of the words so far, by start and period."""
        if not self.caught:
            return []
        q, a, b = _merged(np.concatenate(self.caught, axis=1))
        n = len(self.words)
        right = self._furthest(lambda m: self._same(b, q, m), n - q - b)
        left = self._furthest(lambda m: self._same(a - m, q, m), a)
        found = self._long(a - left, b + right + q, q)
        words = self.words
        for start, length, p in found:
            end = start + length
            if words[start : end - p] != words[start + p : end] or (start and words[start - 1] == words[start + p - 1]) or (end < n and words[end] == words[end - p]):
                return self._by_word(np.unique(q))
        return found

    @staticmethod
    def _furthest(holds, most: np.ndarray) -> np.ndarray:
        """The largest m of 0 to ``most`` for which it holds; it holds for all smaller ones."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            m = (low + high + 1) // 2
            ok = holds(m)
            low, high = np.where(ok, m, low), np.where(ok, high, m - 1)
        return low

    def _long(self, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
        """Of one stretch with several periods the smallest counts, of which the others are multiples."""
        keep = end - start >= np.maximum(self.shortest, self.times * q)
        least: dict[tuple[int, int], int] = {}
        for s, e, p in zip(start[keep].tolist(), end[keep].tolist(), q[keep].tolist(), strict=True):
            least[s, e] = min(p, least.get((s, e), p))
        return sorted((s, e - s, p) for (s, e), p in least.items())

    def _by_word(self, periods: np.ndarray) -> list[tuple[int, int, int]]:
        place: dict[bytes, int] = {}
        ids = np.fromiter((place.setdefault(w, len(place)) for w in self.words), np.int64, len(self.words))
        parts = []
        for q in periods.tolist():
            cuts = np.concatenate([[-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(ids) - q]])
            parts.append(np.stack([cuts[:-1] + 1, cuts[1:] + q, np.full(len(cuts) - 1, q)]))
        return self._long(*np.concatenate(parts, axis=1))


def _merged(squares: np.ndarray) -> np.ndarray:
    """Columns (period, first, last) with those of one period that touch made one."""
    q, a, b = squares[:, np.lexsort((squares[1], squares[0]))]
    # a period is caught at one width, each suffix once: ends rise with the starts
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (a[1:] > b[:-1])
    at = np.flatnonzero(new)
    return np.stack([q[at], a[at], np.maximum.reduceat(b, at)])


def runs_of(texts: Sequence[Sequence[bytes]], shortest: int = 24, times: int = 3, portion: int = 65_536) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words. One catcher takes all texts, with marks between them that equal nothing."""
    words: list[bytes] = []
    starts = []
    for i, text in enumerate(texts):
        starts.append(len(words))
        words.extend(text)
        words.append(b" %d" % i)  # no word has a blank
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    catcher = SquareCatcher(shortest, times, max(map(len, texts), default=0))
    for i in range(0, len(words), portion):
        catcher.append(words[i : i + portion])
    for start, length, q in catcher.runs():
        i = bisect_right(starts, start) - 1
        out[i].append((start - starts[i], length, q))
    return out


def _groups(texts: list[str | None], most: int) -> Iterator[list[list[bytes]]]:
    """The words of the texts, so many texts together that they have ``most`` words, or one that has more."""
    group: list[list[bytes]] = []
    held = 0
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if group and held + len(words) > most:
            yield group
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield group


def kept_words(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> Sequence[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        steps[start + q] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def collapse(docs: DataFrame, shortest: int = 24, times: int = 3, together: int = 16_384) -> DataFrame:
    """``docs`` with each run of ``text`` cut down to its first period, the number of words it had, and its runs."""
    rows = docs.select(*without(docs, "n_words", "runs"))
    at = [c.lower() for c in rows.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in slices(batches, 100):
            texts, sizes, found = [], [], []
            given = batch.column(at).to_pylist()
            for group in _groups(given, together):
                for words, runs in zip(group, runs_of(group, shortest, times), strict=True):
                    sizes.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    texts.append(b" ".join(kept_words(words, runs)).decode("utf-8", "surrogatepass"))
            texts = [None if g is None else t for g, t in zip(given, texts, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names, "n_words", "runs"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS)]))
