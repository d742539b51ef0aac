"""Context builders by name: each gives the questions of a run their ranked rows. Users add their own with ``builder``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import retrieval

Builder = Callable[..., DataFrame]
BUILDERS: dict[str, Builder] = {}


def builder(name: str) -> Callable[[Builder], Builder]:
    """Registers a function of (questions, chunks, k, options) that returns (question_id, rank, chunk_id)."""

    def add(f: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"there is a context builder {name} already")
        BUILDERS[name] = f
        return f

    return add


def build(name: str, questions: DataFrame, chunks: DataFrame, k: int, **options) -> DataFrame:
    """The context of ``questions(question_id, corpus, tokens)`` from ``chunks(corpus, chunk_id, tokens)`` by a named builder."""
    if name not in BUILDERS:
        raise ValueError(f"no context builder {name}; there are {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name](questions, chunks, k, **options).select("question_id", "rank", "chunk_id")


@builder("bm25")
def bm25(questions: DataFrame, chunks: DataFrame, k: int, page_cap: int | None = None) -> DataFrame:
    return retrieval.bm25_top(questions, chunks, k, page_cap)


@builder("phrase")
def phrase(questions: DataFrame, chunks: DataFrame, k: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """Over all corpora, by the question's most frequent words."""
    terms = retrieval.keywords(questions, list(stop)).groupBy("question_id").agg(F.collect_list("term").alias("terms"))
    found = retrieval.phrase_rank(terms, chunks.select(F.col("chunk_id").alias("note_id"), "tokens"), k)
    return found.withColumnRenamed("note_id", "chunk_id")


@builder("hybrid")
def hybrid(questions: DataFrame, chunks: DataFrame, k: int, k_phrase: int = 3, stop: tuple[str, ...] = ()) -> DataFrame:
    """BM25's rows, then those of the phrase rank that aren't among them."""
    return retrieval.hybrid(bm25(questions, chunks, k), phrase(questions, chunks, k_phrase, stop), "question_id", "chunk_id")
