"""Steps that hold little: few texts at a time, words gathered once, rows dealt to all cores."""

import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import blocks, chunks
from docquarry.plans.common import spread


def test_words_are_shuffled_once(spark):
    words = spark.createDataFrame([(1, 0, 1, 1, "b"), (1, 0, 1, 0, "a"), (1, 1, 0, 0, "d"), (1, 0, 2, 0, " "), (1, 0, 3, 5, "c"), (2, 0, 0, 0, "")], "k int, b int, l int, p int, w string")
    whole = words.select("k", *[F.coalesce(c, F.lit(-1)).alias(c) for c in "blp"], "w")
    for rows in (words, whole):
        got = chunks.pages_of_words(rows, ["k"], "b", "l", "p", "w")
        assert [tuple(r) for r in got.collect()] == [(1, "a b\nc\nd")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_few_texts_are_cut_at_a_time(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["n"])
    assert [b.num_rows for b in blocks.few(iter([batch, batch.slice(0, 0), batch.slice(0, 30)]))] == [200] * 5 + [30]
    rows = spark.range(3000).select("id", F.lit("one two. three").alias("t")).coalesce(1)
    assert blocks.split_texts(rows, "id", "t", 8, 2).count() == 3000 * len(blocks.split_pieces("one two. three", 8, 2))


def test_fitted_prompts_take_arrow_texts(spark):
    assert tx.fitted_prompt.evalType != F.pandas_udf(lambda x: x, "string").evalType
    rows = spark.createDataFrame([("a b c d", 9), ("a " * 500, 40), (None, 3), ("a", None)], "t string, n int").select(tx.fitted_prompt("t", "n").alias("p")).collect()
    want = [(*tx.longest_fit("a b c d", 9), False), (*tx.longest_fit("a " * 500, 40), True)]
    assert [tuple(r.p) for r in rows[:2]] == want and rows[2].p.content is None and rows[3].p.content is None


def test_small_files_are_dealt_to_all_cores(spark):
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_windows_count_empty_pages_and_pages_of_one_number(spark, tmp_path):
    """As the SQL has it: empty pages inside a window are pages of it, null numbers come last, equal ones after each other."""
    import duckdb

    from docquarry.plans import graph

    words = lambda n: "w " * n
    rows = [(1, words(200), "a"), (2, None, "a"), (3, "...", "a"), (4, "", "a"), (5, words(900), "a"), (None, words(300), "a"), (6, words(100), "a"), (7, words(700), None)]
    rows += [(10, words(400), "b"), (10, words(200), "b"), (11, words(50), "b"), (12, None, "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = graph.cross_windows(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(f"select {', '.join(got.columns)} from ({graph.SQL_CROSS})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[4] == 3 and r[5] == 200 for r in want)
