"""Tables and SQL that several query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small file that cost much time each, dealt to all cores: a file's size doesn't tell."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def sql_tokens(column: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}_]+')"


#: A benchmark item asks the documents of one source.
SQL_QUESTIONS = f"questions AS (SELECT item_id AS question_id, 'src' || (item_id % 20) AS corpus, {sql_tokens('text')} AS tokens FROM benchmark)"
SQL_CHUNKS = f"chunks AS (SELECT source AS corpus, doc_id AS chunk_id, {sql_tokens('text')} AS tokens FROM documents)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions to the documents of one source."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("corpus"), tx.tokens(F.col("text")).alias("tokens")
    )


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document one chunk of its source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.col("doc_id").alias("chunk_id"), tx.tokens(F.col("text")).alias("tokens"))


#: Four consecutive vectors are the token vectors of a page; label is its document. Queries: pages divisible by 50.
SQL_PAGES = """pages4 AS (SELECT vec_id // 4 AS page_id, vec_id % 4 AS tok, embedding::DOUBLE[] AS v, label FROM embeddings)"""


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, vecs, grp)``: multi-vector pages."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("page_id"), (F.col("vec_id") % 4).alias("tok"), "embedding", "label")
    return rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok", "embedding"))), lambda x: x["embedding"]).alias("vecs"), F.min("label").alias("grp"))


def single_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, vecs, grp)``: every vector a page of one vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.array("embedding").alias("vecs"), F.col("label").alias("grp"))


def asked(pages: DataFrame) -> DataFrame:
    """The stated query set: pages whose id is divisible by 50."""
    return pages.where(F.col("page_id") % 50 == 0).withColumnRenamed("page_id", "query_id")
