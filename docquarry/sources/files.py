"""Readers and writers of samples, results, rankings and graphs. Paths are any that Spark reaches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of JSON lines. Blank lines are skipped; malformed ones too, or fail the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def with_default_id(samples: DataFrame, name: str, number: str) -> DataFrame:
    """Rows without an id get their line number."""
    return samples.withColumn(name, F.coalesce(F.col(name), F.col(number).cast("string")))


def short_path(prefix: str, path: Column) -> Column:
    """Prefix and the last two parts of a path."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.lit(prefix), F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)))


def read_qrels(spark: SparkSession, path: str, threshold: int | None = None) -> DataFrame:
    """``(qid, docid, rel)`` of a tab-separated file with a header; at or over a threshold if given."""
    rows = spark.read.schema("qid string, docid string, rel int").csv(path, sep="\t", header=True)
    return rows if threshold is None else rows.where(F.col("rel") >= threshold)


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, docid, score)`` of TREC lines with six or three columns."""
    cut = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    six = F.size("c") >= 6
    return cut.where(F.size("c") >= 3).select(
        F.col("c")[0].alias("qid"), F.when(six, F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(1))).alias("docid"), F.when(six, F.get("c", F.lit(4))).otherwise(F.get("c", F.lit(2))).cast("double").alias("score")
    )


def write_trec(run: DataFrame, path: str, tag: str = "run") -> None:
    """``run(qid, docid, score)`` as six-column TREC lines, ranked from 1 by score and docid."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "docid"))
    run.select(F.concat_ws("\t", "qid", F.lit("Q0"), "docid", rank.cast("string"), F.col("score").cast("string"), F.lit(tag)).alias("value")).write.mode("overwrite").text(path)


def until_first_gap(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages of each document from 0 on, up to the first that is missing; repeats of a page stay.

    The first gap is the least page that follows none or a page, and isn't there: joins and sums by document, no sort of it.
    """
    there = pages.select(F.col(doc).alias("there_doc"), F.col(page).cast("bigint").alias("there_page")).distinct()
    after = there.select("there_doc", F.explode(F.array(F.lit(0).cast("bigint"), F.col("there_page") + 1)).alias("after")).distinct()
    known = there.select(F.col("there_doc").alias("known_doc"), F.col("there_page").alias("known_page"))
    missing = after.join(known, (F.col("there_doc") == F.col("known_doc")) & (F.col("after") == F.col("known_page")), "left_anti")
    gaps = missing.groupBy(F.col("there_doc").alias("gap_doc")).agg(F.min("after").alias("gap"))
    return pages.join(gaps, (F.col(doc) == F.col("gap_doc")) & (F.col(page) < F.col("gap"))).select(*pages.columns)


def first_source(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """For each key the value of the first source that has one."""
    every = None
    for i, s in enumerate(sources):
        part = s.where(F.col(value).isNotNull()).select(*keys, value, F.lit(i).alias("__from"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*keys).agg(F.min_by(value, "__from").alias(value))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Node and edge tables, rows of a document together and sorted, so that a document is read from few row groups.

    Spark's committer makes a table's files appear together at the end of its job.
    """
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.repartition(F.col("doc_key")).sortWithinPartitions("doc_key").write.mode("overwrite").parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def run_parameters(name: Column, keys: list[str]) -> Column:
    """Parameters of a run's name as a map; a number's point may be written as an underscore."""
    found = [F.regexp_replace(F.nullif(F.regexp_extract(name, rf"_{re.escape(k)}_(\d+(?:_\d+)?)", 1), F.lit("")), "_", ".") for k in keys]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*found)), lambda _, v: v.isNotNull())


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated records with a header."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def result_name(params: dict[str, Column], model: Column) -> Column:
    """File name of a run from its parameters and model, values as runs of plain characters; ``unknown`` for none."""
    plain = lambda v: F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.replace(v.cast("string"), F.lit(":free"), F.lit("")), "[^A-Za-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("unknown"))
    return F.concat(F.concat_ws("_", F.lit("res"), *[x for k, v in params.items() for x in (F.lit(k), plain(v))], plain(model)), F.lit(".jsonl"))
