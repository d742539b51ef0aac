"""Which samples and pages take part: limits, id lists, retries; jobs, manifests and what is ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import document_key


def first_samples(samples: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first samples in file order; none for a negative limit, all without one."""
    return samples if limit is None else samples.orderBy(order).limit(max(0, limit))


def _ids(values: DataFrame | None, name: str) -> DataFrame | None:
    return None if values is None else values.select(F.col(values.columns[0]).cast("string").alias(name)).distinct()


def select_samples(samples: DataFrame, docs: DataFrame | None, questions: DataFrame | None, either: bool = False) -> DataFrame:
    """Samples whose document (by id or by file key) and question are listed; a list that isn't given asks for nothing.

    ``either`` is the retry mode: one of the two is enough, and lists that aren't given match nothing.
    ``samples(doc_id, question_id, ...)``; lists are tables of one column, so they may be of any size.
    """
    out = samples
    marks: list[Column] = []
    if docs is not None:
        for name, key in (("doc_raw", F.col("doc_id").cast("string")), ("doc_key", document_key(F.col("doc_id").cast("string")))):
            out = out.join(_ids(docs, name), key == F.col(name), "left")
        marks.append(F.col("doc_raw").isNotNull() | F.col("doc_key").isNotNull())
    if questions is not None:
        out = out.join(_ids(questions, "question_listed"), F.col("question_id").cast("string") == F.col("question_listed"), "left")
        marks.append(F.col("question_listed").isNotNull())
    keep = F.lit(not either)
    for m in marks:
        keep = keep | m if either else keep & m
    return out.where(keep).select(*samples.columns)


def failed_keys(log: DataFrame, kind: str) -> DataFrame:
    """Keys of a kind whose latest entry of ``log(kind, key, status, at)`` is a failure."""
    last = log.where(F.col("kind") == kind).groupBy("key").agg(F.max_by("status", "at").alias("status"))
    return last.where("status = 'failed'").select("key")


def graph_mode(nodes: DataFrame, edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that a mode leaves: ``page_only`` keeps page nodes and no edges, others the edge types they name."""
    if mode == "page_only":
        return nodes.where("is_page"), edges.where(F.lit(False))
    if mode not in MODES:
        raise ValueError(f"no such graph mode: {mode}")
    kinds = MODES[mode]
    return nodes, edges if kinds is None else edges.where(F.col("type").isin(*kinds))


#: Edge types of each graph mode; None for all.
MODES = {
    "full_graph": None,
    "containment_only": ("containment",),
    "structural_graph": ("containment", "section_hierarchy", "hierarchy", "reading_order"),
    "semantic_graph": ("containment", "semantic"),
    "layout_graph": ("containment", "layout"),
}


def first_pages(pages: DataFrame, page: str, limit: int | None) -> DataFrame:
    """Pages of a lower index than the limit."""
    if limit is None:
        return pages
    if limit < 1:
        raise ValueError("a page limit is at least 1")
    return pages.where(F.col(page) < limit)


def cache_variant(parameters: dict[str, Column]) -> Column:
    """The name of a cached variant: parameters in a fixed order, values of plain characters."""
    plain = lambda v: F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.substring_index(v.cast("string"), "/", -1), "[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit("")), F.lit("checkpoint"))
    return F.concat_ws("_", *[x for k, v in parameters.items() for x in (F.lit(k), plain(v))])


def memory_jobs(records: DataFrame, order: str) -> DataFrame:
    """``(memory_id, ...)``: one job for each document of ``records(benchmark, main_doc, ...)``, the first record's."""
    key = F.concat(F.lit("mem_"), "benchmark", F.lit("_doc_"), document_key(F.substring_index("main_doc", "/", -1)))
    keyed = records.withColumn("memory_id", key)
    return keyed.withColumn("r", F.row_number().over(Window.partitionBy("memory_id").orderBy(order))).where("r = 1").drop("r")


def ready(jobs: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Jobs all parts of which are there."""
    for p in parts:
        jobs = jobs.join(p.select(F.col(key).alias("there")).distinct(), F.col(key) == F.col("there"), "left_semi")
    return jobs


def token_owners(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """``hits(token, ...)`` with the page that owns each token, ``tokens(token, page_id)``."""
    return hits.join(tokens.select(F.col("token").alias("known"), F.col("page_id").alias("owner")), F.col("token") == F.col("known")).drop("known")


def generation_docs(run: DataFrame, k: int) -> DataFrame:
    """``(qid, docids)`` of the k best documents of each query of ``run(qid, docid, score)``; fewer than k fail the read."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "docid"))
    top = run.withColumn("rank", rank).where(F.col("rank") <= k)
    held = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "docid"))), lambda x: x["docid"]).alias("docids"))
    return held.withColumn("docids", F.when(F.size("docids") < k, F.raise_error(F.concat(F.lit("too few documents for "), "qid"))).otherwise(F.col("docids")))


def positive_docs(qid: Column, separator: str | None = None) -> Column:
    """Documents that a query's id names: all but its last part after a dash, or the parts before its number."""
    if separator is None:
        return F.array(F.regexp_replace(qid, "-[^-]*$", ""))
    return F.split(F.substring_index(qid, "query_number", 1), separator)


def checked_vectors(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """``rows``; a vector of another length fails the read."""
    size = F.size(vector)
    return rows.withColumn(vector, F.when(size == dim, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dim} values is expected, found "), size.cast("string")))))


def latest_mapping(sources: list[DataFrame]) -> DataFrame:
    """``(id, url)`` of the last source that has both; within a source the last line."""
    every = None
    for i, s in enumerate(sources):
        part = s.where("coalesce(id, '') <> '' and coalesce(url, '') <> ''").select("id", "url", F.struct(F.lit(i).alias("source"), "line").alias("at"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.max_by("url", "at").alias("url"))


def content_file(files: DataFrame, doc: str, name: str, exact: str, suffix: str) -> DataFrame:
    """``(doc, name)``: each document's file of the exact name, else the first that ends in the suffix."""
    fits = files.where((F.col(name) == exact) | F.col(name).endswith(suffix))
    return fits.groupBy(doc).agg(F.min(F.struct((F.col(name) != exact).alias("other"), name)).alias("first")).select(doc, F.col(f"first.{name}").alias(name))
