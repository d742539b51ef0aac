"""Periodic runs against a version that compares all words at every distance."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import periodic
from docquarry.llm.queries import op12_periodic_runs

DATA = "/root/testdata/sf0.001"


def plain_runs(words, shortest=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            a = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(shortest, times * q):
                found.setdefault((a, i + q - a), q)
            i += 1
    return sorted((a, length, q) for (a, length), q in found.items())


def plain_kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]


def repetitive(rng):
    letters = rng.choice([1, 2, 3, 50])
    word = lambda: b"%d" % rng.randrange(letters)
    words = [word() for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(4)):
        base = [word() for _ in range(rng.randrange(1, 25))]
        words += (base * 20)[: rng.randrange(10, 120)] + [word() for _ in range(rng.randrange(4))]
    return words


def test_runs_equal_plain_version():
    rng = random.Random(1)
    texts = [repetitive(rng) for _ in range(250)]
    want = [plain_runs(t) for t in texts]
    assert periodic.runs_of(texts) == want == periodic.runs_of(texts, portion=50) and sum(map(len, want)) > 200
    for text, runs in zip(texts, want, strict=True):
        catcher = periodic.SquareCatcher()
        size = rng.choice([1, 3, 40])
        for i in range(0, len(text), size):
            catcher.append(text[i : i + size])
        assert catcher.runs() == runs
        if catcher.caught:  # what is done should hashes err
            assert catcher._by_word(np.unique(np.concatenate(catcher.caught, axis=1)[0])) == runs
        assert periodic.kept_words(text, runs) == plain_kept(text, runs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=20), st.integers(0, 150), st.lists(st.sampled_from([b"a", b"c"]), max_size=30))
def test_runs_of_any_period(period, length, tail):
    words = (period * 150)[:length] + tail
    assert periodic.runs_of([words]) == [plain_runs(words)]


def test_runs_are_known_while_words_come():
    catcher = periodic.SquareCatcher()
    catcher.append([b"x"] * 30)
    assert catcher.runs() == [(0, 30, 1)]
    catcher.append([b"x"] * 5 + [b"y"])
    assert catcher.runs() == [(0, 35, 1)]
    with pytest.raises(ValueError):
        periodic.SquareCatcher(shortest=10)


def test_hashes_that_err_are_found_out(monkeypatch):
    rng = random.Random(4)
    texts = [repetitive(rng) for _ in range(40)]
    monkeypatch.setattr(periodic, "hash", lambda w: len(w) % 3, raising=False)
    assert periodic.runs_of(texts, portion=1000)[0] == plain_runs(texts[0])
    for t in texts:
        assert periodic.runs_of([t]) == [plain_runs(t)]


def test_long_text_of_one_word():
    assert periodic.runs_of([[b"w"] * 200_000, [], [b"w"] * 24, [b"w"] * 23]) == [[(0, 200_000, 1)], [], [(0, 24, 1)], []]


def test_collapse_edge_cases(spark):
    texts = [None, "", " \n ", "a b", "a b " * 20 + "c", "é ü " * 30, "x\x1c" * 50, "Z" * 100_000]
    docs = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)] + [(None, "q " * 40, None, 1), (4, "q", None, 1)], "doc_id bigint, text string, Runs string, n int")
    got = periodic.collapse(docs)
    assert got.columns == ["doc_id", "text", "n", "n_words", "runs"]
    rows = {(r.doc_id, r.n): r for r in got.collect()}
    assert [rows[i, i].text for i in range(8)] == [None, "", "", "a b", "a b c", "é ü", texts[6], texts[7]]
    assert [tuple(r) for r in rows[4, 4].runs] == [(0, 40, 2)] and rows[None, 1].text == "q" and rows[4, 1].n_words == 1
    assert periodic.collapse(docs.limit(0)).count() == 0


def test_query_equals_plain_version(spark):
    got = {r.doc_id: r for r in op12_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if n > 3000:  # the plain version's time goes with the square
            continue
        runs, row = plain_runs(words), got[doc_id]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(plain_kept(words, runs))).hexdigest()
    assert planted > 5
