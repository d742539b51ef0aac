"""Search indexes against exact rankings and plain searches."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from docquarry.operators import indexes
from docquarry.operators.retrieval import vector_top_k


def clustered(seed, families, each, dim, spread):
    rng = np.random.default_rng(seed)
    x = np.concatenate([b + rng.normal(size=(each, dim)) * spread for b in rng.normal(size=(families, dim))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_product_codes_find_the_best_in_a_quarter_of_the_cells(spark):
    x = clustered(1, 60, 50, 32, 0.25)
    pages = spark.createDataFrame(list(enumerate(x.tolist())), "page_id bigint, vec array<double>").repartition(4)
    queries = pages.where("page_id % 50 = 0").withColumnRenamed("page_id", "query_id")
    quantiser = indexes.fit_quantiser(pages, cells=32, parts=8)
    index = indexes.pq_index(pages, quantiser)
    assert index.count() == len(x) and len(index.first().code) == 8 and "cell" in index.columns
    found = indexes.pq_search(queries, index, pages, quantiser, 5, probes=8, rerank=60, block=100)
    got = {(r.query_id, r.page_id) for r in found.collect()}
    score = x[::50] @ x.T
    want = {(50 * i, int(j)) for i, row in enumerate(score) for j in np.argsort(-row)[:5]}
    assert len(got & want) >= 0.9 * len(want)
    exact = {(r.query_id, r.page_id): r.score for r in found.collect()}
    assert all(abs(score[q // 50, p] - s) < 1e-9 for (q, p), s in exact.items())
    # every cell read and everything ranked again: the exact ranking
    all_of = indexes.pq_search(queries, index, pages, quantiser, 5, probes=32, rerank=len(x))
    assert {(r.query_id, r.page_id) for r in all_of.collect()} == want
    assert indexes.pq_search(queries.limit(0), index, pages, quantiser, 5, probes=8).count() == 0


def test_estimates_follow_products():
    x = clustered(2, 30, 40, 24, 0.3)
    quant = indexes.Quantiser.fit(x, 8, 6)
    cell = indexes._nearest(x, quant.centroids)[:, 0]
    code = quant.encode(x - quant.centroids[cell])
    tables = quant.tables(x[:20])
    guess = (x[:20] @ quant.centroids.T)[:, cell] + sum(tables[:, s][:, code[:, s]] for s in range(6))
    assert np.corrcoef(guess.ravel(), (x[:20] @ x.T).ravel())[0, 1] > 0.95


def test_products_of_codes_take_a_few_megabytes():
    rng = np.random.default_rng(5)
    quant = indexes.Quantiser(rng.normal(size=(4, 32)), [rng.normal(size=(256, 2)) for _ in range(16)])
    for n_queries, n_codes in ((2048, 300), (400, 16_384)):
        q, code = rng.normal(size=(n_queries, 32)), rng.integers(0, 256, (n_codes, 16)).astype(np.uint8)
        tracemalloc.start()
        i, j, guess = indexes.guesses(q, q @ quant.centroids[0], code, quant, 50)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30e6 and len(i) == 50 * n_queries
        near = quant.tables(q[:1])[0][np.arange(16), code].sum(1) + q[0] @ quant.centroids[0]
        assert np.allclose(np.sort(guess[i == 0]), np.sort(near)[-50:])


def test_pruned_late_interaction(spark):
    x = clustered(3, 80, 16, 24, 0.15).reshape(80, 16, 24)
    rng = np.random.default_rng(4)
    pages = [x[p][rng.choice(16, 8, replace=False)] for p in range(80) for _ in range(5)]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pages)], "page_id bigint, vecs array<array<double>>")
    queries = df.where("page_id % 20 = 0").withColumnRenamed("page_id", "query_id")
    exact = vector_top_k(queries, df, 5).collect()
    got = indexes.pruned_maxsim(queries, df, 5, cells=40, probes=4, candidates=40).collect()
    scores = {(r.query_id, r.page_id): r.score for r in exact}
    assert len({(r.query_id, r.page_id) for r in got} & set(scores)) >= 0.9 * len(exact)
    assert all(abs(scores[r.query_id, r.page_id] - r.score) < 1e-9 for r in got if (r.query_id, r.page_id) in scores)
    assert indexes.pruned_maxsim(queries.limit(0), df, 5, 4, 2, 4).count() == 0


def test_pruned_pages_of_the_tables(spark):
    """On vectors without clusters too, if enough is asked for."""
    from docquarry.plans.retrieval import maxsim_sum, pruned_maxsim

    data = "/root/testdata/sf0.001"
    want, got = ({(r.query_id, r.page_id) for r in f(spark, data).collect()} for f in (maxsim_sum, pruned_maxsim))
    assert len(got & want) >= 0.9 * len(want)


def test_substrings(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abé \n.*(") for _ in range(n))
    docs = [(rng.choice("xy"), i, text(rng.randrange(200))) for i in range(60)] + [("x", 60, ""), ("y", 61, None), ("x", 62, "a" * 5000)]
    terms = [(c, text(n)) for c in "xy" for n in (1, 2, 3, 4, 5, 6) for _ in range(6)] + [("x", "aaaa"), ("x", ""), ("y", "zzz")]
    got = {(r.corpus, r.doc_id, r.term): r.n for r in indexes.substring_counts(spark.createDataFrame(docs, "corpus string, doc_id bigint, h string"), spark.createDataFrame(terms, "corpus string, term string"), "doc_id").collect()}
    want = {(c, i, t): h.count(t) for c, i, h in docs for k, t in set(terms) if k == c and t and h and t in h}
    assert got == want and len(want) > 300


def test_substring_plan_joins_on_runs(spark):
    docs, terms = spark.createDataFrame([("x", 1, "abcd")], "corpus string, doc_id bigint, h string"), spark.createDataFrame([("x", "bcd")], "corpus string, term string")
    plan = indexes.substring_counts(docs, terms, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "corpus" in plan and "gram" in plan and not [line for line in plan.splitlines() if "Join" in line and "=" not in line]


def test_candidates_make_no_row_for_a_token_and_a_page(spark):
    """The plan pairs blocks of queries with blocks of pages; several blocks give what one gives."""
    x = clustered(5, 20, 24, 16, 0.3).reshape(160, 3, 16)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)] + [(900, []), (901, None)], "page_id bigint, vecs array<array<double>>")
    queries = df.where("page_id % 20 = 0").withColumnRenamed("page_id", "query_id")
    one, several = (indexes.pruned_maxsim(queries, df, 5, cells=16, probes=4, candidates=20, block=b) for b in (16_384, 10))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not [line for line in plan.splitlines() if "Join" in line and "cell" in line]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, several.collect())) and one.count() == 40


def test_runs_that_nobody_asks_for_are_no_rows(spark):
    """Before the join with the asked runs there are few rows a text, not one for each of its runs."""
    docs = spark.createDataFrame([("x", i, "".join(random.Random(i).choices("abcdefghijklmnop ", k=4000))) for i in range(20)], "corpus string, doc_id bigint, h string")
    wanted = spark.createDataFrame([("abc",), ("b",), ("de",), ("\U0001f600é",)], "gram string").select(indexes._gram_code(F.col("gram")).alias("run"))
    held = indexes._held_grams(docs, "corpus", "doc_id", wanted)
    assert 20 * 2 <= held.count() <= 20 * 40
