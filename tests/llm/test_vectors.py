"""Nearest neighbours and whitening against plain versions."""

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import ann, whitening

VECTORS = "vec_id bigint, embedding array<double>"


def plain_search(rows, is_query, k):
    """All products, added up component after component; rows are (vec_id, vector)."""
    ok = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if is_query(i):
            found = [(-reduce(lambda s, p: s + p[0] * p[1], zip(q, v, strict=True), 0.0), j) for b, (j, v) in enumerate(ok) if a != b and len(v) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def clustered(rng, families, dim, spread):
    rows = []
    for _ in range(families):
        base = rng.normal(size=dim)
        rows += [(base + rng.normal(size=dim) * spread).tolist() for _ in range(int(rng.integers(1, 60)))]
    return rows


def test_search_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 12, 24, 0.2) + rng.normal(size=(60, 24)).tolist() + rng.normal(size=(5, 3)).tolist() + [[1.0, 0.0]]
    vectors += vectors[:3] * 40 + [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23]
    rows = list(enumerate(vectors)) + [(7, vectors[3]), (7, vectors[7]), (7, vectors[7]), (None, vectors[0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("H", F.lit(1)).withColumn("cell", F.lit("x")).repartition(5)
    want = plain_search(rows, lambda i: i % 7 == 0, 20)
    for options in ({}, {"block": 16, "first": 2}, {"max_cells": 1, "bits": 64}):
        got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 7 == 0, **options).collect())
        assert got == want, (options, sorted(set(got) ^ set(want))[:20])
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 400"), F.lit(True)).count() == 0


def test_codes_estimate_within_their_bounds():
    rng = np.random.default_rng(5)
    for dim, bits in ((24, 256), (100, 128)):
        x, q = rng.normal(size=(400, dim)), rng.normal(size=(50, dim)) * 3
        x[0] = 0
        code, f, cosine = ann.encode(x, bits)
        codes = ann.QueryCodes(q, bits)
        got = codes.estimates(slice(0, 50), code, np.bitwise_count(code).sum(1)) * f
        deviation = np.sqrt(bits / (bits - 1) * ((1 - cosine**2) * codes.length2[:, None] + codes.rest2[:, None])) * f
        off = (got - q @ x.T)[:, 1:] / deviation[:, 1:]
        assert (np.abs(off) > 4).mean() < 1e-3 and 0.5 < off.std() < 1.05 and (got[:, 0] == 0).all()


def test_recall_of_many_cells(spark):
    rng = np.random.default_rng(6)
    vectors = np.array(clustered(rng, 120, 32, 0.4) + rng.normal(size=(1500, 32)).tolist())
    rows = list(enumerate(vectors.tolist()))
    df = spark.createDataFrame(rows, VECTORS)
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, first=2, block=500).collect()}
    score = vectors[::20] @ vectors.T
    score[np.arange(len(score)), np.arange(len(score)) * 20] = -np.inf
    want = {(20 * i, int(j)) for i, row in enumerate(score) for j in np.argsort(-row)[:20]}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def plain_whitening(vectors, k=8):
    """Eigenvectors of the covariance of centred whole numbers; deviations in whole numbers."""
    x = [[int(np.floor(1024.0 * c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in x], np.float64) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    keep = min(k, int((e > 1e-12 * e[0]).sum()))
    return [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x], e[:keep], centred @ v[:, :keep] / np.sqrt(e[:keep]), e[:keep] / e.sum()


def whitened(df, **options):
    rows = whitening.whiten(df, **options).collect()
    assert len({r.identity_error for r in rows}) <= 1
    return {(r.vec_id, r.component): r for r in rows}


def test_whitening_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 1000)
    rng = np.random.default_rng(8)
    for dim, scales in ((12, np.geomspace(3, 0.05, 12)), (40, np.r_[np.geomspace(5, 0.5, 30), np.full(10, 0.4)]), (5, np.ones(5))):
        vectors = (rng.normal(size=(300, dim)) * scales) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        df = spark.createDataFrame(list(enumerate(vectors.tolist())), VECTORS).repartition(4)
        got = whitened(df)
        deviation, e, y, explained = plain_whitening(vectors)
        assert len(got) == len(vectors) * len(e)
        for c in range(len(e)):
            mine = np.array([got[i, c + 1].whitened for i in range(len(vectors))])
            assert np.abs(mine * np.sign(mine @ y[:, c]) - y[:, c]).max() < 1e-8
        r = got[17, 1]
        assert (r.n, r.deviation) == (300, deviation[17]) and r.identity_error < 1e-10
        np.testing.assert_allclose([got[0, c + 1].explained for c in range(len(e))], explained, rtol=1e-10)


def test_whitening_of_equal_and_missing_variances(spark):
    corners = [[float(s * (i == j)) for j in range(10)] for i in range(10) for s in (-1, 1)]  # one variance ten times
    got = whitened(spark.createDataFrame(list(enumerate(corners)), VECTORS))
    assert len(got) == 20 * 8 and got[0, 1].identity_error < 1e-10
    twice = np.random.default_rng(9).normal(size=(50, 3))
    flat = np.c_[twice, twice, np.ones(50)]  # three dimensions of seven
    got = whitened(spark.createDataFrame(list(enumerate(flat.tolist())), VECTORS))
    assert len(got) == 50 * 3 and got[0, 1].identity_error < 1e-10 and abs(sum(got[0, c].explained for c in (1, 2, 3)) - 1) < 1e-10


def test_whitening_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.25, 1.0]), (6, [0.5, -1.0]), (None, [0.5, 3.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("N", F.lit(1)).withColumn("component", F.lit("x"))
    rows = sorted((r.vec_id or 0, r.component, r.n, r.deviation) for r in whitening.whiten(df).collect())
    want = plain_whitening([[0.25, 1.0], [0.5, -1.0], [0.5, 3.0]])[0]
    assert rows == sorted((i, c, 3, d) for i, d in zip((6, 6, 0), want, strict=True) for c in (1, 2))
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 7")).count() == 0
    huge = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 0.0]), (3, [0.0, 1.0])], VECTORS)
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None, 2048**2}
