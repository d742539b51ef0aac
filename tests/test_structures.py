"""Balanced bins, plans, note links and prompts against plain versions."""

import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import balance, dags, notes


def greedy_spread(sizes, bins):
    sums = [0] * bins
    heapq.heapify(sums)
    for s in sorted(sizes, reverse=True):
        heapq.heappush(sums, heapq.heappop(sums) + s)
    return max(sums) - min(sums)


def sums(rows, bins):
    out = [0] * bins
    for r in rows:
        out[r.bin] += r.size
    return out


def test_largest_differencing_of_few():
    assert balance.difference([([0, s], s) for s in (8, 7, 6, 5, 4)])[0] == [14, 16]  # the known result of the method
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(3, 10))]
        got, members = balance.difference([([0, 0, s], i) for i, s in enumerate(sizes)])
        assert sorted(n for m in members for n, b in m if b == 2) == list(range(len(sizes)))
        assert [sum(sizes[n] for n, b in m if b == 2) for m in members] == got and sum(got) == sum(sizes)
        # never further from even than the largest size, as for every merge of states
        assert max(got) - min(got) <= max(sizes)


@pytest.mark.parametrize("options", [{}, {"top": 1000, "fine": 60}])
def test_balanced_bins(spark, options):
    rng = random.Random(2)
    rows = [(i, int(rng.paretovariate(1.2) * 100)) for i in range(3000)] + [(3000, 0), (3000, 7), (None, 5)]
    df = spark.createDataFrame(rows, "key bigint, size bigint").repartition(3)
    got = balance.karmarkar_karp(df, "size", "key", 8, **options).collect()
    assert sorted((r.key or -1, r.size) for r in got) == sorted((k or -1, s) for k, s in rows)
    found = sums(got, 8)
    bundle = sum(s for _, s in rows) / (8 * 60) if options else 0
    assert max(found) - min(found) <= max(bundle, greedy_spread([s for _, s in rows], 8))
    equal = balance.karmarkar_karp(df, "size", "key", 8, equal_size=True, **options).collect()
    counts = [sum(r.bin == b for r in equal) for b in range(8)]
    assert max(counts) - min(counts) <= (1 if not options else 12) and max(sums(equal, 8)) - min(sums(equal, 8)) <= max(s for _, s in rows)
    assert balance.karmarkar_karp(df.limit(0), "size", "key", 8).count() == 0


def test_documents_no_worse_than_greedy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("n_chars").alias("size"))
    found = sums(balance.karmarkar_karp(docs, "size", "doc_id", 8).collect(), 8)
    assert max(found) - min(found) <= greedy_spread([r.size for r in docs.collect()], 8)


def plain_order(ids, children):
    """Free nodes first come first served; None if some never are."""
    after = {n: [c for c in found if c in set(ids)] for n, found in zip(ids, children)}
    waiting = {n: sum(c == n for found in after.values() for c in found) for n in ids}
    queue, out = [n for n in ids if not waiting[n]], []
    while queue:
        n = queue.pop(0)
        out.append(n)
        for c in after[n]:
            waiting[c] -= 1
            if not waiting[c]:
                queue.append(c)
    return out if len(out) == len(ids) else None


def test_execution_order(spark):
    rng = random.Random(3)
    graphs, rows = {}, []
    for g in range(40):
        ids = rng.sample(range(100), rng.randrange(1, 15))
        later = lambda i: [c for c in ids[i + 1 :] + [777] if rng.random() < 0.3]  # noqa: E731, B023
        children = [later(i) + ([ids[0]] if g % 5 == 0 and i and rng.random() < 0.5 else []) for i in range(len(ids))]
        graphs[g] = (ids, children)
        rows += [(g, i, n, c or None) for i, (n, c) in enumerate(zip(ids, children))]
    chain = list(range(10_000))
    rows += [(100, i, i, [i + 1]) for i in chain] + [(101, i, i, [(i + 1) % 10_000]) for i in chain] + [(102, i, i, []) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, ordinal int, node int, children array<int>").repartition(5)
    got = {}
    for r in dags.execution_order(df, "g", max_nodes=10_000).collect():
        got.setdefault(r.g, []).append(r)
    for g, (ids, children) in graphs.items():
        want, found = plain_order(ids, children), sorted(got[g], key=lambda r: r.position)
        assert [r.node for r in found] == (want or ids) and all(r.valid == (want is not None) for r in found)
        level = {r.node: r.level for r in found}
        for n, below in zip(ids, children):
            assert want is None or all(level[c] > level[n] for c in below if c in level)
        assert all((777 in r.unknown) == (777 in children[ids.index(r.node)]) for r in found)
    assert {r.level for r in got[100]} == set(chain) and {r.reason for r in got[101]} == {"cycle"}
    small = dags.execution_order(df.where("g = 102"), "g", max_nodes=10).collect()
    assert {(r.valid, r.reason, r.position) for r in small} == {(False, "too many nodes", None)}
    assert dags.execution_order(df.limit(0), "g").count() == 0


def test_links_to_earlier_notes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    x[7] = 0
    x[60:70] = x[5]
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "note_id bigint, vec array<double>").repartition(4)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = set()
    for i in range(120):
        near = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in range(i) if i != 7 and j != 7)[:5]
        want |= {(3 * i, 3 * j, rank) for rank, (_, j) in enumerate(near, 1)}
    for block in (16, 4096):
        assert {(r.note_id, r.earlier, r.rank) for r in notes.earlier_links(df, block=block).collect()} == want
    assert notes.earlier_links(df.limit(0)).count() == 0


def stepwise(text, budget):
    """Each try cut and counted as a whole."""
    count = lambda s: len(re.findall(r"\w+|[^\w\s]", s))
    if count(text) <= budget:
        return text, count(text)
    low, high, best = 0, len(text), ""
    while low <= high:
        middle = (low + high) // 2
        cut = tx.cut_middle(text, middle)
        if count(cut) <= budget:
            best, low = cut, middle + 1
        else:
            high = middle - 1
    return best, count(best)


def test_prompts_fit_their_budget(spark):
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["word", "é", ", ", " ", "\n\n", "...", "x1_y ", "(", "日本"]) for _ in range(rng.randrange(120)))
        budget = rng.randrange(60)
        assert tx.longest_fit(text, budget) == stepwise(text, budget)
    df = spark.createDataFrame([("a b c " * 100, 30), (None, 3), ("", 0), ("a b", 2), ("a b", None)], "t string, n int")
    rows = [tuple(r.p) for r in df.select(tx.fitted_prompt("t", "n").alias("p")).collect()]
    assert rows[0][1] <= 30 and rows[0][2] and rows[1] == (None, None, None) and rows[2] == ("", 0, False) and rows[3] == ("a b", 2, False) and rows[4][0] is None


def test_memory_saved_and_loaded(spark, tmp_path):
    path = str(tmp_path / "m")
    made = spark.createDataFrame([(1, "a", ["k"]), (2, None, None)], "note_id bigint, content string, keywords array<string>")
    vectors = spark.createDataFrame([(2, [1.0, 2.0]), (1, [0.5, 0.0])], "note_id bigint, vec array<double>")
    notes.save_memory(made, vectors, path)
    got = {r.note_id: (r.content, r.keywords, r.links, r.vec) for r in notes.load_memory(spark, path).collect()}
    assert got == {1: ("a", ["k"], None, [0.5, 0.0]), 2: (None, None, None, [1.0, 2.0])}
    for some, of in ((made.limit(0), vectors), (made, vectors.where("note_id = 1")), (made.where("note_id = 1"), vectors)):
        with pytest.raises(ValueError):
            notes.save_memory(some, of, path)
    spark.createDataFrame([(3, [1.0])], "note_id bigint, vec array<double>").write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(ValueError):
        notes.load_memory(spark, path)
