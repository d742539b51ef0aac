"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding and decoding. All but
the last return the columns of ``documents``, further ones included.

Edge cases: a null, empty or word-less text is rejected by the classifier. Rows of null doc_id have their own lines
deduplicated, are never near copies, and go on otherwise. Rows of equal doc_id are one document: rejected together,
and of equal ones all stay or one group's smallest id does. A document of which line dedup leaves nothing goes. A null source
or lang is a site of its own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, decontaminate, line_dedup, quality, simhash
from docquarry.llm._shared import Scratch, tidy
from docquarry.llm.queries import table, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; hosts are sources, paths their languages."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go; a document of which no line is left goes too. n_chars follows the text."""
    cleaned = line_dedup.clean(docs).where("not (n_removed > 0 and text = '')")
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and digests of its ids and of the text decoded from them."""
    return bpe.digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Classifier, fingerprints and BPE merges can't be said in SQL; tests/llm holds a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. What a stage has read and left goes once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with tidy():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.leave(f"stage-{i}")
    return docs
