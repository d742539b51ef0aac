"""Table functions in SQL against the operators and plain versions."""

import json

import pytest
from pyspark.errors import AnalysisException

from docquarry.functions import tables
from docquarry.operators.blocks import split_pieces

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def session(spark):
    tables.register(spark)
    spark.read.parquet(f"{DATA}/documents.parquet").createOrReplaceTempView("docs_for_tables")
    return spark


def test_pieces_in_sql(session):
    got = session.sql("SELECT * FROM text_pieces(TABLE(docs_for_tables), 'doc_id', 'text', 1000, 100)")
    assert got.columns == ["doc_id", "piece", "content"] and got.schema["doc_id"] == session.table("docs_for_tables").schema["doc_id"]
    want = {(r.doc_id, i, p) for r in session.table("docs_for_tables").collect() for i, p in enumerate(split_pieces(r.text, 1000, 100))}
    assert {tuple(r) for r in got.collect()} == want
    lines = session.sql("SELECT lang, count(*) AS n FROM text_pieces(TABLE(SELECT lang, text FROM docs_for_tables) PARTITION BY (lang), 'LANG', 'Text', 500, 0) GROUP BY lang").collect()
    assert {r.lang for r in lines} == {r.lang for r in session.table("docs_for_tables").select("lang").distinct().collect()}


def test_windows(session):
    texts = [(1, "one two three four five six"), (2, ""), (3, None), (4, "a, b"), (5, "x y z w v")]
    session.createDataFrame(texts, "k int, t string").createOrReplaceTempView("short_texts")
    got = [tuple(r) for r in session.sql("SELECT * FROM token_windows(TABLE(short_texts), 'k', 't', 3, 1) ORDER BY k, window").collect()]
    assert got == [(1, 0, 0, 2, "one two three"), (1, 1, 2, 4, "three four five"), (1, 2, 4, 5, "five six"), (4, 0, 0, 1, "a, b"), (5, 0, 0, 2, "x y z"), (5, 1, 2, 4, "z w v")]


def test_metrics(session):
    rows = [("a", json.dumps({"acc": 0.5, "count": 4, "by": {"x": {"f1": 1, "count": 2}, "y": {"f1": 0.25, "ok": True}}})), ("b", "{broken"), ("c", None)]
    session.createDataFrame(rows, "run string, m string").createOrReplaceTempView("runs_for_tables")
    got = {tuple(r) for r in session.sql("SELECT * FROM flat_metrics(TABLE(runs_for_tables), 'run', 'm')").collect()}
    assert got == {("a", "", "acc", 0.5, 4), ("a", "", "count", 4.0, 4), ("a", "by.x", "f1", 1.0, 2), ("a", "by.x", "count", 2.0, 2), ("a", "by.y", "f1", 0.25, 4)}


@pytest.mark.parametrize("call", ["'no', 't', 3, 1", "'k', 't', 0, 0", "'k', 't', 3, 3"])
def test_wrong_arguments_are_told_before_running(session, call):
    session.createDataFrame([(1, "a")], "k int, t string").createOrReplaceTempView("short_texts")
    with pytest.raises(AnalysisException):
        session.sql(f"SELECT * FROM token_windows(TABLE(short_texts), {call})")
