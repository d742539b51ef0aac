"""Byte-level BPE encoding and decoding by a depth-first walk over a trie of distinct words.

The encoding of a word is a chain of tokens in which every neighbouring pair is itself a valid encoding, and each
prefix of a word has exactly one last token. So the state of a trie node is its last token; it follows from the
states above it by trying the tokens that end there, and is computed once for all words that share the prefix.
Distinct words of a batch go in sorted order, which is the trie in depth-first order. Words of up to ``SHORT`` bytes
are walked together, one depth of the trie after the other: the tokens of all their substrings come from a trie of the
vocabulary, and the states of a depth are arrays. Longer words, and a few alone, go depth first: what two neighbours
share is kept on the stack, only the rest of the path is walked.

Scale: a map over the documents without a shuffle. A worker keeps the encodings of words in use in two rounds of a
bounded number of bytes, and of the depth-first walk the pairs of tokens tried and the ends of paths met up to a
bounded number, so memory is bounded and no word is left out.

Splitting into words follows the vocabulary's own pre-tokenizer: texts of plain Latin characters by an equal
pattern of the standard library, all others by the tokenizers library's splitter.

Edge cases: null text is encoded as the empty text: no ids. Strings of special tokens in a text become their ids.
A repeated row gives a repeated result. Extra columns pass through ``encode``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docquarry.llm._shared import Recent, resident, slices, without

#: Characters for which the standard library's classes equal those of the pre-tokenizer; all others go to its own code.
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]")


def _class(pattern: str) -> str:
    """The characters without a match of ``_OTHER`` that fit the pattern, listed: found faster than negated classes."""
    return "[" + "".join(re.escape(c) for c in map(chr, range(0x2100)) if not _OTHER.match(c) and re.fullmatch(pattern, c)) + "]"


_WORD = re.compile(rf" ?{_class(r'[^\W\d_]')}+|'(?:[stmd]|re|ve|ll)| ?{_class(r'\d')}+| ?{_class(r'[^\s\w]|_')}+|\s+(?!\S)|\s+")

#: Bytes of the words that are walked together, and how many of them at a time.
SHORT, TOGETHER = 32, 20_000


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``start``, one after the other."""
    at = np.repeat(start - np.cumsum(size) + size, size)
    at += np.arange(len(at))
    return values[at]


class Codes:
    """Numbers below 2**24 for distinct keys below 2**39, looked up many at a time: open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        if len(keys) and (keys.max() >= 1 << 39 or values.max() >= 1 << 24):
            raise ValueError("a vocabulary beyond these tables")
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.entries = np.full(1 << bits, -1, np.int64)
        at, new = self.slots(keys), keys << 24 | values
        while len(new):
            free = self.entries[at] < 0
            self.entries[at[free]] = new[free]  # of those that meet in a slot, the others go on
            left = self.entries[at] != new
            at, new = (at[left] + 1) & self.last, new[left]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of these keys (int64), -1 for unknown ones."""
        at = self.slots(keys)
        entry = self.entries[at]
        held = entry >> 24
        out = np.where(held == keys, entry & 0xFFFFFF, -1)
        left = np.flatnonzero((held != keys) & (entry >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.last
            entry = self.entries[at]
            hit = entry >> 24 == keys[left]
            out[left[hit]] = entry[hit] & 0xFFFFFF
            on = ~hit & (entry >= 0)
            at, left = at[on], left[on]
        return out


class TrieBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, max_bytes: int = 120_000_000, few: int = 100):
        """``max_bytes``: about what the tables of words, pairs and ends may take together. ``few``: so many short words aren't walked together."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {ord(c): b for b, c in byte_characters().items()}
        as_bytes = lambda s: s.translate(back).encode("latin-1")
        self.vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.halves = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.made_at = {a + b: i for (a, b), i in reversed(self.rank.items())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {v: k for k, v in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        #: A token that the merges don't make of its own bytes is no state of the trie.
        self.made: dict[bytes, bool] = {}
        #: About 280 bytes an entry of these two.
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.most = max_bytes // 8 // 280
        #: Lengths over 4 of the tokens that end in these 4 bytes; and, of paths met, of all tokens that can end there.
        self.long_ends: dict[bytes, set[int]] = {}
        for t in self.vocab:
            if len(t) > 4:
                self.long_ends.setdefault(t[-4:], set()).add(len(t))
        self.ends: dict[bytes, tuple[int, ...]] = {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Ids of words, as the bytes of 32-bit integers.
        self.words = Recent(3 * max_bytes // 8)
        self.path, self.few = path, few
        self._library = None
        self._tables()

    def _tables(self) -> None:
        """What walks of many words look up by arrays."""
        vocab, n = self.vocab, max(self.bytes_of) + 1
        pieces = [self.bytes_of.get(i, b"") for i in range(n)]
        self.size = np.fromiter(map(len, pieces), np.int64, n)
        self.piece_at, self.piece_bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(pieces), np.uint8)
        self.decimals = np.array([b"%d," % i for i in range(n)])
        number = lambda tokens: np.fromiter((vocab.get(t, -1) for t in tokens), np.int64)
        a, b = number(a for a, _ in self.rank), number(b for _, b in self.rank)
        known = (a >= 0) & (b >= 0)
        self.base, self.ranks = n, Codes((a * n + b)[known], np.fromiter(self.rank.values(), np.int64)[known])
        #: Of each token: the merge that made it, its halves, and whether the merges make it of its own bytes (-1: not tried).
        made, a, b = number(self.halves), number(a for a, _ in self.halves.values()), number(b for _, b in self.halves.values())
        known = made >= 0
        self.merge, self.left, self.right, self.whole = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int8)
        self.merge[made[known]] = np.fromiter((self.made_at[t] for t in self.halves), np.int64)[known]
        self.left[made[known]], self.right[made[known]] = a[known], b[known]
        # the trie of the vocabulary, one depth after the other; node 0 is its root
        ids, size = np.fromiter(vocab.values(), np.int64), np.fromiter(map(len, vocab), np.int64)
        begin, letters = np.cumsum(size) - size, np.frombuffer(b"".join(vocab), np.uint8)
        node, keys, token, nodes = np.zeros(len(ids), np.int64), [], [np.full(1, -1)], 1
        for d in range(min(SHORT, int(size.max()))):
            on = size > d
            ids, size, begin, node = ids[on], size[on], begin[on], node[on]
            key, of = np.unique(node * 256 + letters[begin + d], return_inverse=True)
            node = nodes + of
            here = np.full(len(key), -1)
            here[of[size == d + 1]] = ids[size == d + 1]
            keys.append(key)
            token.append(here)
            nodes += len(key)
        keys = np.concatenate(keys)
        self.child, self.token_at = Codes(keys, np.arange(1, nodes)), np.concatenate(token)
        self.inner = np.bincount(keys >> 8, minlength=nodes) > 0

    def merged(self, piece: bytes) -> list[bytes]:
        """The plain merge loop; used on single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))  # noqa: B905
            if best == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: bytes, token: bytes) -> bool:
        """Whether the merges leave this pair of tokens as it is.

        Takes both apart again, the later merge first, and looks at the tokens that faced each other across
        the border at that time: the pair doesn't hold if a merge of these came before.
        """
        key = (before, token)
        if len(self.pairs) > self.most:
            self.pairs.clear()
        rank, made_at, limit, ok = self.rank, self.made_at, 1 << 60, True
        while True:
            if rank.get((before, token), limit) < limit:
                ok = False
                break
            a, b = made_at.get(before, -1), made_at.get(token, -1)
            if a > b:
                limit, before = a, self.halves[before][1]
            elif b >= 0:
                limit, token = b + 1, self.halves[token][0]
            else:
                break
        self.pairs[key] = ok
        return ok

    def alone(self, token: bytes) -> bool:
        if (known := self.made.get(token)) is None:
            known = self.made[token] = self.merged(token) == [token]
        return known

    def lengths(self, end: bytes) -> tuple[int, ...]:
        """Lengths of the tokens that can end a path whose last bytes (4, or all of a shorter path) are these."""
        long = sorted(self.long_ends.get(end, ()), reverse=True) if len(end) == 4 else []
        if len(self.ends) > self.most:
            self.ends.clear()
        self.ends[end] = out = (*long, *(n for n in range(len(end), 0, -1) if end[len(end) - n :] in self.vocab))
        return out

    def wholes(self, tokens: np.ndarray) -> np.ndarray:
        """``alone`` of many tokens."""
        new = np.unique(tokens[self.whole[tokens] < 0])
        self.whole[new] = [self.alone(self.bytes_of[i]) for i in new.tolist()]
        return self.whole[tokens] > 0

    def hold(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs."""
        ok, at, limit = np.ones(len(before), bool), np.arange(len(before)), np.full(len(before), 1 << 60)
        while len(at):
            rank = self.ranks.get(before * self.base + token)
            broken = (rank >= 0) & (rank < limit)
            ok[at[broken]] = False
            a, b = self.merge[before], self.merge[token]
            on = np.flatnonzero(~broken & ((a >= 0) | (b >= 0)))
            at, before, token, a, b = at[on], before[on], token[on], a[on], b[on]
            first = a > b
            limit = np.where(first, a, b + 1)
            before, token = np.where(first, self.right[before], before), np.where(first, token, self.left[token])
        return ok

    def walk_together(self, words: list[str]) -> dict[str, bytes]:
        """The encodings of sorted distinct words of up to ``SHORT`` bytes, one depth of their trie after the other."""
        data = [w.encode("utf-8") for w in words]
        count, size = len(data), np.fromiter(map(len, data), np.int64, len(data))
        most, word = int(size.max()), np.repeat(np.arange(count), size)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        letters = np.zeros((most, count), np.uint8)
        letters[depth, word] = np.frombuffer(b"".join(data), np.uint8)

        # a node is the place (depth, first of the neighbours that share the path)
        new, node, fresh = np.arange(count) == 0, np.zeros((most + 1, count), np.int64), np.zeros((most + 1, count), bool)
        for d in range(most):
            new[1:] |= letters[d, 1:] != letters[d, :-1]
            have = np.flatnonzero(size > d)
            begins = np.diff(np.cumsum(new)[have], prepend=-1) != 0
            fresh[d + 1, have] = begins
            node[d + 1, have] = have[begins][np.cumsum(begins) - 1] + (d + 1) * count
        letters, node, fresh = letters.ravel(), node.ravel(), fresh.ravel()

        # tokens that end in a node: from each place down the trie of the vocabulary
        at, left = depth * count + word, size[word] - depth
        start, here, ends = node[at], np.zeros(len(at), np.int64), []
        for n in range(1, most + 1):
            here = self.child.get(here * 256 + letters[at])
            at += count
            token = self.token_at[here]
            hit = np.flatnonzero((here >= 0) & (token >= 0) & fresh[at])
            ends.append((at[hit], start[hit], token[hit]))
            on = np.flatnonzero((here >= 0) & self.inner[here] & (left > n))
            at, left, start, here = at[on], left[on], start[on], here[on]
        end, start, token = map(np.concatenate, zip(*ends, strict=True))

        state = np.full((most + 1) * count, -1)
        level = (end // count).astype(np.uint8)
        order, bounds = np.argsort(level, kind="stable"), np.cumsum(np.bincount(level, minlength=most + 1))
        for a, b in zip(bounds, bounds[1:]):  # noqa: B905
            some = order[a:b]
            e, s, t = end[some], start[some], token[some]
            top = s == 0
            ok = np.empty(len(some), bool)
            ok[top] = self.wholes(t[top])
            ok[~top] = self.hold(state[s[~top]], t[~top])
            state[e[ok]] = t[ok]

        # from each word's last token back to its first
        at, word, found = size, np.arange(count), []
        while len(word):
            token = state[node[at * count + word]]
            if (token < 0).any():
                raise KeyError("a byte that the vocabulary lacks")
            found.append((word, token))
            at = at - self.size[token]
            word, at = word[at > 0], at[at > 0]
        stop = np.cumsum(np.bincount(np.concatenate([w for w, _ in found]), minlength=count))
        ids = np.empty(stop[-1], np.int32)
        for k, (word, token) in enumerate(found, 1):
            ids[stop[word] - k] = token
        raw, stops = ids.tobytes(), (4 * stop).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *stops], stops)}  # noqa: B905

    def walk(self, words: list[str]) -> None:
        """Encodes distinct new words into ``self.words``."""
        short = sorted(w for w in words if len(w) <= SHORT // 4 or len(w.encode("utf-8")) <= SHORT)
        if len(short) > self.few:
            for a in range(0, len(short), TOGETHER):
                self.words.add(self.walk_together(short[a : a + TOGETHER]))
            words = list(set(words).difference(short))
        self.walk_down(words)

    def walk_down(self, words: list[str]) -> None:
        """Encodes distinct new words into ``self.words``, depth first."""
        found: dict[str, bytes] = {}
        vocab, pairs, ends, lengths, fits, alone = self.vocab, self.pairs, self.ends, self.lengths, self.fits, self.alone
        last: list[bytes] = [b""]  # last token of each prefix on the path; that of the root is empty
        path = b""
        for data, text in sorted((w.encode("utf-8"), w) for w in words):
            top = min(len(path), len(data))
            if path[:top] == data[:top]:
                shared = top
            else:
                low, shared = 0, top  # the first difference lies in [low, shared)
                while shared - low > 1:
                    mid = (low + shared) // 2
                    low, shared = (mid, shared) if path[:mid] == data[:mid] else (low, mid)
                shared = low
            del last[shared + 1 :]
            for d in range(shared + 1, len(data) + 1):
                end = data[d - 4 : d] if d > 4 else data[:d]
                for n in ends[end] if end in ends else lengths(end):
                    if n < d:
                        key = (last[d - n], data[d - n : d])
                        if (ok := pairs.get(key)) is None:
                            ok = key[1] in vocab and fits(*key)
                        if ok:
                            break
                    elif n == d and data[:d] in vocab and alone(data[:d]):
                        break
                last.append(data[d - n : d])
            path = data
            ids, d = [], len(data)
            while d:
                ids.append(vocab[last[d]])
                d -= len(last[d])
            found[text] = np.array(ids[::-1], np.int32).tobytes()
        self.words.add(found)

    def split(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return _WORD.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        special, at = self.special, self.split_special
        parts = []
        for text in texts:
            text = text or ""
            if at and any(s in text for s in special):
                parts.append(list(chain.from_iterable([p] if p in special else self.split(p) for p in at.split(text))))
            else:
                parts.append(self.split(text))
        self.words.turn()
        self.walk(list(self.words.lacking(set().union(*parts).difference(special))))
        self.words.now.update((s, np.int32(i).tobytes()) for s, i in special.items())
        get = self.words.now.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        if not size.all() or (ids < 0).any():
            raise KeyError("an id that the vocabulary lacks")
        parts = (slice(a, a + 50_000) for a in range(0, len(ids), 50_000))
        return b"".join(gathered(self.piece_bytes, self.piece_at[ids[p]], size[p]).tobytes() for p in parts).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimals[ids].tobytes().replace(b"\0", b"")[:-1]


def encoder(path: str) -> TrieBPE:
    """That of this worker; the tasks of a stage share the words met so far."""
    return resident(("bpe", path), lambda: TrieBPE(path))


def _runs(texts: list[str | None], size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` characters, so that ids of a large batch aren't all in memory at once."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= size:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``docs`` with a last column of token ids of ``text``; an input column of that name is replaced."""
    kept = docs.select(*without(docs, column))
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, 2000):
            texts = batch.column(at).to_pylist()
            for a, b in _runs(texts):
                rows = bpe.encode_arrays(texts[a:b])
                ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, column: str = "decoded", ids: str = "ids") -> DataFrame:
    """``rows`` with a last column: the text of ``ids``; null for null. Bytes that are no UTF-8 become U+FFFD."""
    kept = rows.select(*without(rows, column))
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if i is None else bpe.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document doc_id, n_tokens and the digests of its ids and of the text decoded from them.

    Encodes, decodes and digests in one pass, so that ids don't travel between processes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, 2000):
            texts, n, ids_sha, text_sha = batch.column(1).to_pylist(), [], [], []
            for a, b in _runs(texts):
                for ids in bpe.encode_arrays(texts[a:b]):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(bpe.listed(ids)).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(
        run, T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    )
