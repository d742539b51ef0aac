"""Edge cases of the scalar functions and operators, by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import literals
from docquarry.functions import scoring as fn
from docquarry.functions import text as tx
from docquarry.operators import chunks, controller, graph, metrics, results, retrieval, samples
from docquarry.plans.common import asked, single_vectors
from docquarry.sources import files


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_anls_threshold_and_empty(spark):
    rows = [("abcd", "abxy"), ("", ""), ("abc", "abc"), ("abcd", "abcx")]
    assert one(spark, rows, "g string, p string", fn.anls(F.col("g"), F.col("p"))) == [(0.0,), (1.0,), (1.0,), (0.75,)]


def test_clean_l_strips_suffixes_in_order(spark):
    rows = [("team",), ("5 km",), ("$1,200 million",), ('"12%"',), ("3 (about)",)]
    assert [r[0] for r in one(spark, rows, "t string", fn.clean_l(F.col("t")))] == ["tea", "5 k", "1200", "12", "3"]
    assert [r[0] for r in one(spark, [("5 miles",), ("12 million",)], "t string", fn.clean_m(F.col("t")))] == ["5", "12"]


def test_scores_by_format(spark):
    rows = [("5.0", "5", "Int"), ("five", "5", "Int"), ("12%", "0.12", "Float"), ("x", "1", "Float"), ("https://a.b", "https://a.c", "Str"), ("hello", "hellp", "Str")]
    got = [r[0] for r in one(spark, rows, "g string, p string, k string", fn.score_m(F.col("g"), F.col("p"), F.col("k")))]
    assert got[:5] == [1.0, 0.0, 1.0, None, 0.0] and got[5] == pytest.approx(0.8)


def test_lists(spark):
    rows = [(["b", "a"], ["a", "b"]), (["a"], ["a", "b"]), (["1", "2"], ["2", "1"])]
    schema = "g array<string>, p array<string>"
    assert [r[0] for r in one(spark, rows, schema, fn.list_score_m(F.col("g"), F.col("p")))] == [1.0, 0.0, 1.0]
    got = [r[0] for r in one(spark, rows, schema, fn.list_score_l(F.col("g"), F.col("p")))]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.5**0.5) and got[2] == 0.0


def test_short_abstract(spark):
    long = one(spark, [("x" * 301,)], "t string", tx.short_abstract(F.col("t")))[0][0]
    assert len(long) == 302 and long.endswith("...")
    assert one(spark, [("x" * 300,)], "t string", tx.short_abstract(F.col("t")))[0][0] == "x" * 300


def test_text_helpers(spark):
    assert one(spark, [("A b.PDF",), ("...",)], "t string", tx.document_key(F.col("t"))) == [("A_b",), ("document",)]
    assert one(spark, [("a]]>b",)], "t string", tx.cdata(F.col("t"))) == [("<![CDATA[a]]]]><![CDATA[>b]]>",)]
    assert one(spark, [("a &amp; b c\n\n\n\nd",)], "t string", tx.normalize_text(F.col("t"))) == [("a & b c\n\nd",)]


def test_windows_stop_at_the_end(spark):
    rows = [("d", i, ["w"] * n) for i, n in enumerate((0, 4, 5, 6, 7))]
    cut = chunks.page_windows(spark.createDataFrame(rows, "doc string, page int, tokens array<string>"), ["doc", "page"], 4, 2)
    starts = {r.page: sorted(r.s) for r in cut.groupBy("page").agg(F.collect_list("start").alias("s")).collect()}
    assert starts == {0: [0], 1: [0], 2: [0, 2], 3: [0, 2], 4: [0, 2, 4]}
    with pytest.raises(ValueError):
        chunks.check_window(4, 4)


def test_best_pages_of_documents(spark):
    rows = [("doc1", 0, 10), ("doc1", 1, 50), ("doc1", 2, 30), ("doc2", 0, 40), ("doc2", 1, 20), ("doc2", 2, 60), ("doc3", 0, 70), ("doc3", 1, 90)]
    df = spark.createDataFrame(rows, "d string, p int, s int")
    best = retrieval.top_k(df, ["d"], [F.col("s").desc(), F.col("p")], 1).orderBy(F.col("s").desc()).limit(2)
    assert [(r.d, r.p, r.s) for r in best.collect()] == [("doc3", 1, 90), ("doc2", 2, 60)]


def test_bm25_keeps_zero_scores(spark):
    q = spark.createDataFrame([(1, "c", ["a", "a"]), (2, "c", ["zzz"])], "question_id int, corpus string, tokens array<string>")
    c = spark.createDataFrame([("c", 0, ["b"]), ("c", 1, ["a", "b"]), ("c", 2, ["b", "b"])], "corpus string, chunk_id int, tokens array<string>")
    got = {(r.question_id, r["rank"]): (r.chunk_id, r.score > 0) for r in retrieval.bm25_top(q, c, 2).collect()}
    assert got == {(1, 1): (1, True), (1, 2): (0, False), (2, 1): (0, False), (2, 2): (1, False)}


def test_section_parents(spark):
    rows = [("d", 0, i, t, lv) for i, (t, lv) in enumerate([("paragraph", 0), ("title", 1), ("title", 2), ("title", 3), ("title", 2), ("title", 1), ("paragraph", 0)])]
    n = spark.createDataFrame(rows, "doc_key string, page_index int, block_index int, type string, level int").withColumn("id", F.col("block_index").cast("string"))
    assert {(r.source, r.target) for r in graph.sections(n).collect()} == {("1", "2"), ("2", "3"), ("1", "4"), ("5", "6")}


def test_controller_rules(spark):
    said = {
        0: ("open 1, activate 1, open 1, open 1, activate 1", ["Active", "Active", "Inactive"], 2),  # opened once, then active again
        1: ("prune 0, activate 1, open 1, activate 0, activate 2", ["Active", "Inactive", "Active"], 2),  # nothing under a pruned page
        2: ("activate 0, open 0, prune 2, prune 2, look 1", ["Active", "Inactive", "Pruned"], 2),  # pages aren't opened
        3: ("activate 0, activate 1", ["Inactive", "Inactive", "Inactive"], 2),  # outside the mask
    }
    rows = [(p, i, s.split()[0], int(s.split()[1]), p < 3) for p, (text, _, _) in said.items() for i, s in enumerate(text.split(", "))]
    df = spark.createDataFrame(rows, "page int, i int, action string, node int, allowed boolean")
    got = {r.page: (r.states, r.n_refused) for r in controller.replay(df, ["page"], ["i"], 3).collect()}
    assert got == {p: (states, refused) for p, (_, states, refused) in said.items()}


def test_dag_cycles_are_refused(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "parent int, child int")
    assert {r.node: r.depth for r in controller.depths(edges, spark.createDataFrame([(1,)], "node int"), 5).collect()} == {1: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError):
        controller.depths(spark.createDataFrame([(1, 2), (2, 1)], "parent int, child int"), spark.createDataFrame([(1,)], "node int"), 5)


def test_metrics(spark):
    rows = spark.createDataFrame([(1.0, True, True), (0.0, True, False), (1.0, False, False)], "score double, answerable boolean, pred_answerable boolean")
    r = metrics.acc_and_f1(rows).first()
    assert (r.acc, r.recall, r.precision) == (pytest.approx(2 / 3), 0.5, 1.0)
    assert metrics.group_advantages(spark.createDataFrame([("a", 1.0)], "p string, v double"), "p", "v").count() == 0


def test_compact_keeps_last_record_in_first_place(spark):
    rows = spark.createDataFrame([("a", 1, True, 1), ("b", 2, True, 2), ("a", 3, True, 3), ("a", 4, False, 4)], "k string, line int, ok boolean, v int")
    assert {r.k: (r.first_line, r.v) for r in results.compact(rows, "k", "line", F.col("ok")).collect()} == {"a": (1, 3), "b": (2, 2)}


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=True).collect()
    name = files.result_name({"k": F.lit(3), "size": F.lit("a b:free")}, F.lit("m/x"))
    assert spark.range(1).select(name).first()[0] == "res_k_3_size_a_b_m_x.jsonl"


def test_gaps_and_repeated_pages(spark):
    rows = [("a", 0), ("a", 0), ("a", 1), ("a", 3), ("b", 1), ("c", 0), ("c", 1), ("c", 1)]
    got = files.until_first_gap(spark.createDataFrame(rows, "doc string, page int"), "doc", "page").collect()
    assert sorted((r.doc, r.page) for r in got) == [("a", 0), ("a", 0), ("a", 1), ("c", 0), ("c", 1), ("c", 1)]


def test_numbers_are_consecutive_whatever_the_size(spark):
    n = 5_000_000
    got = results.numbered(spark.range(n).select((F.col("id") * 7919 % n).alias("x")), "x", "number").agg(F.countDistinct("number"), F.min("number"), F.max("number"), F.count_if(F.col("number") != F.col("x") + 1)).first()
    assert tuple(got) == (n, 1, n, 0)


def test_running_sums_by_parts(spark):
    rng = random.Random(2)
    rows = [(g, o, rng.randrange(9)) for g in ("hot", "b") for o in rng.sample(range(5000), 700 if g == "hot" else 5)] + [("hot", 9000, 1), ("hot", 9000, 2)]
    got = {(r.g, r.o, r.v): (r.before, r.total) for r in chunks.before(spark.createDataFrame(rows, "g string, o int, v int"), "g", "o", "v", 64).collect()}
    for g, o, v in rows:
        assert got[g, o, v] == (sum(x for h, p, x in rows if h == g and p < o), sum(x for h, _, x in rows if h == g))


def test_vectors_in_blocks(spark):
    rng = np.random.default_rng(1)
    pages = [(i, i % 3, rng.normal(size=(1 + i % 4, 5)).tolist()) for i in range(60)] + [(60, 0, [])]
    df = spark.createDataFrame(pages, "page_id int, grp int, vecs array<array<double>>")
    score = lambda q, p: round(sum(max(np.dot(a, b) for b in p) for a in q), 9)
    queries = df.where("page_id % 7 = 0 and page_id < 60").withColumnRenamed("page_id", "query_id")
    for options in ({}, {"query_block": 3, "page_block": 7}):
        for masked in (False, True):
            got = {}
            for r in retrieval.vector_top_k(queries, df, 4, same_group=masked, skip_self=True, **options).collect():
                got.setdefault(r.query_id, []).append((r["rank"], r.page_id))
            for q, g, v in pages[::7][:9]:
                want = sorted((-score(v, x), p) for p, h, x in pages if x and p != q and (not masked or h == g))[:4]
                assert sorted(got[q]) == [(i, p) for i, (_, p) in enumerate(want, 1)]


def test_cell_search_recall(spark):
    d = "/root/testdata/sf0.1"
    pages = single_vectors(spark, d)
    exact = {(r.query_id, r.page_id) for r in retrieval.vector_top_k(asked(pages), pages, 5).collect()}
    found = {(r.query_id, r.page_id) for r in retrieval.cell_search(asked(pages), pages, 5, cells=16, probes=12).collect()}
    print(f"recall of the cell index: {len(exact & found) / len(exact):.3f}")
    assert len(exact & found) >= 0.9 * len(exact)


def test_list_scores_against_all_assignments():
    rng = random.Random(5)
    for _ in range(300):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        s = [[rng.choice([0, 0.25, 0.5, rng.random()]) for _ in range(m)] for _ in range(n)]
        small, large = (n, m) if n <= m else (m, n)
        best = max(sum(s[i][j] if n <= m else s[j][i] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small))
        pairs = literals.best_assignment(s)
        assert len(pairs) == small and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == small
        assert sum(s[r][c] for r, c in pairs) == pytest.approx(best)
    assert literals.list_f1(["The 12 cats"], ["twelve cat", "12"]) == 0.33 and literals.list_em(["Twenty one"], ["20.0 1"]) == 1.0
    assert literals.list_f1(["year 1999"], ["year 2000"]) == 0.0 and literals.parse_items("{'a'}") == ["a"] and literals.parse_items(None) == []


def test_vectors_of_wrong_size_fail(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, v array<double>")
    assert samples.checked_vectors(df.where("id = 1"), "v", 2).count() == 1
    with pytest.raises(Exception, match="2 values is expected"):
        samples.checked_vectors(df, "v", 2).collect()


def test_sample_lists(spark):
    s = spark.createDataFrame([("a.pdf", "1"), ("b", "2"), ("c", "3")], "doc_id string, question_id string")
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    pick = lambda *a, **k: sorted(r.question_id for r in samples.select_samples(s, *a, **k).collect())
    assert pick(None, None) == ["1", "2", "3"] and pick(ids("a"), None) == ["1"] and pick(ids("a.pdf", "b"), ids("2", "3")) == ["2"]
    assert pick(ids("a"), ids("3"), either=True) == ["1", "3"] and pick(None, None, either=True) == []
    assert samples.first_samples(s, "question_id", -1).count() == 0 and samples.first_samples(s, "question_id", None).count() == 3
    with pytest.raises(ValueError):
        samples.first_pages(s, "question_id", 0)


def test_broken_decisions(spark):
    text = "x <agent_decision><selected_actions><action index='2' utility=\"a>b\"><action index=3/></selected_actions><stop>yes</stop><query>q"
    r = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(controller.decision(F.col("t")).alias("d")).collect()
    assert r[0].d.stop and [x.candidate for x in r[0].d.selected] == [2, None] and r[0].d.query == "" and not r[1].d.stop and r[1].d.selected == []


def test_list_scores_of_nulls(spark):
    rows = [(["a"], None), (None, ["a"]), (None, None), (["a", None], ["a", ""]), ([], ["a"]), (["x y"], ["x"])]
    df = spark.createDataFrame(rows, "g array<string>, p array<string>")
    got = [tuple(r) for r in df.select(literals.list_em_score("g", "p"), literals.list_f1_score("g", "p")).collect()]
    assert got[:3] == [(None, None)] * 3 and got[3] == (1.0, got[3][1]) and got[4] == (0.0, 0.0) and 0 < got[5][1] < 1


def test_corrections_that_failed(spark):
    rows = spark.createDataFrame([(True, None, 0.0, None), (True, "e", 1.0, None), (True, None, 1.0, None), (False, None, 0.0, None), (True, None, None, 0.5), (True, None, 0.0, 0.0)], "ran boolean, error string, before double, after double")
    got = [r[0] for r in rows.select(fn.correction_outcome(F.col("ran"), F.col("error"), F.col("before"), F.col("after"), F.col("after"))).collect()]
    assert got == ["correction_error", "correction_error", "skipped_initial_correct", "not_run", "not_run", "wrong_to_wrong"]


def test_whole_reports(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    got = {r.id: r.line for r in results.report(rows, "t", [F.col("k").desc(), F.col("id").asc()]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(3000), key=lambda i: (-(i % 7), i)), 1)}
    assert results.report(rows, "t", [F.col("id").asc()], 5).count() == 5
