"""Queries of sources, sinks, the state machine and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import controller as ctl
from docquarry.operators import results as rs
from docquarry.plans.common import Registry, table
from docquarry.plans.graph import SQL_BLOCKS, SQL_SECTIONS, edges, nodes
from docquarry.sources import files
from docquarry.sources.scratch import scratch_path
from docquarry.streaming import live

R = Registry()


@R.add("s02_s03_k01_jsonl_round_trip", "SELECT event_id::VARCHAR AS sample_id, user_id, event_type, round(value, 6) AS value FROM events")
def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended as JSON lines and read again, with default ids where there are none."""
    path = scratch_path(spark, "jsonl")
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("sample_id"), F.col("event_id").alias("line"), "user_id", "event_type", "value")
    rows.write.mode("append").json(path)
    back = files.read_jsonl(spark, path, "sample_id string, line bigint, user_id bigint, event_type string, value double")
    return files.with_default_id(back, "sample_id", "line").select("sample_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@R.add("s02_short_paths", "SELECT page_id, 'img/' || array_to_string(string_split(url, '/')[greatest(len(string_split(url, '/')) - 1, 1):], '/') AS image FROM pages")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.short_path("img", F.col("url")).alias("image"))


@R.add(
    "s08_until_first_gap",
    """WITH p AS (SELECT lang, doc_id // 20 AS page, doc_id FROM documents JOIN labels USING (doc_id)), d AS (SELECT DISTINCT lang, page FROM p),
g AS (SELECT lang, page, dense_rank() OVER (PARTITION BY lang ORDER BY page) - 1 AS place FROM d) SELECT lang, page, doc_id FROM p JOIN g USING (lang, page) WHERE page = place""",
)
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as pages, 20 ids a page: each language's up to its first page without one."""
    pages = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("lang", F.floor(F.col("doc_id") / 20).alias("page"), "doc_id")
    return files.until_first_gap(pages, "lang", "page")


@R.add("s10_s18_first_source", "SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN 'a' END), max(CASE WHEN event_type = 'click' THEN 'b' END), max(CASE WHEN event_type = 'view' THEN 'c' END)) AS source FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY user_id")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    part = lambda t, v: events.where(F.col("event_type") == t).select("user_id", F.lit(v).alias("source")).distinct()
    return files.first_source([part("purchase", "a"), part("click", "b"), part("view", "c")], ["user_id"], "source")


@R.add(
    "s14_k04_trec_round_trip",
    "SELECT user_id::VARCHAR AS qid, event_id::VARCHAR AS docid, round(value, 6) AS score FROM events",
)
def trec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "trec")
    files.write_trec(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("qid"), F.col("event_id").cast("string").alias("docid"), F.col("value").alias("score")), path)
    return files.read_trec(spark, path).withColumn("score", F.round("score", 6))


@R.add("s13_p14_qrels", "SELECT event_type AS qid, event_id::VARCHAR AS docid, (event_id % 4)::INT AS rel FROM events WHERE event_id % 4 >= 2")
def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "qrels")
    table(spark, sf_dir, "events").select(F.col("event_type").alias("qid"), F.col("event_id").cast("string").alias("docid"), (F.col("event_id") % 4).cast("int").alias("rel")).write.csv(path, sep="\t", header=True)
    return files.read_qrels(spark, path, 2)


@R.add("s07_k03_graph_round_trip", f"WITH {SQL_BLOCKS}, {SQL_SECTIONS} SELECT doc_key, count(*) AS n_nodes, (SELECT count(*) FROM sections s WHERE s.doc_key = nodes.doc_key) AS n_sections FROM nodes GROUP BY doc_key")
def graph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "graph")
    files.write_graph(nodes(spark, sf_dir).select("doc_key", "id", "type"), edges(spark, sf_dir).select("doc_key", "source", "target", "relation"), folder)
    n, e = files.read_graph(spark, folder)
    sections = e.where("relation = 'section'").groupBy("doc_key").agg(F.count("*").alias("n_sections"))
    return n.groupBy("doc_key").agg(F.count("*").alias("n_nodes")).join(sections, "doc_key", "left").select("doc_key", "n_nodes", F.coalesce("n_sections", F.lit(0)).alias("n_sections"))


@R.add("s12_run_parameters", "SELECT p_partkey, p_size::VARCHAR AS k, p_size || '.5' AS b FROM part")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    name = F.concat(F.lit("res_k_"), size, F.lit("_b_"), size, F.lit("_5_model.jsonl"))
    found = files.run_parameters(name, ["k", "b"])
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(found, "b").alias("b"), F.element_at(found, "k").alias("k0")).select("p_partkey", F.substring_index("k0", ".", 1).alias("k"), "b")


@R.add(
    "j19_parameter_sweep",
    """WITH k AS (SELECT DISTINCT p_brand, p_size % 7 AS k FROM part), s AS (SELECT DISTINCT p_brand, 64 * (1 + p_partkey % 5) AS size FROM part), o AS (SELECT DISTINCT p_brand, 32 * (p_size % 6) AS overlap FROM part)
SELECT p_brand, k, size, overlap FROM k JOIN s USING (p_brand) JOIN o USING (p_brand) WHERE overlap < size""",
)
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as experiments: every combination of the values each lists for its three parameters, if the overlap is valid."""
    size = F.col("p_size")
    lists = {"k": size % 7, "size": 64 * (1 + F.col("p_partkey") % 5), "overlap": 32 * (size % 6)}
    return rs.sweep(table(spark, sf_dir, "part"), "p_brand", lists).where("overlap < size")


@R.add("c19_dag_depths", "WITH RECURSIVE t AS (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey // 2 = node AND p_partkey > 1) SELECT node, max(depth)::INT AS depth FROM t GROUP BY node")
def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tasks: the parent of n is n / 2."""
    edges = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).cast("bigint").alias("parent"), F.col("p_partkey").alias("child"))
    roots = table(spark, sf_dir, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("node"))
    return ctl.depths(edges, roots, 40)


@R.add("x_stream_window_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the same counts from a stream over the events file, drained once."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    found = live.drain(spark, live.window_counts(stream, late="3650 days"), "stream")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
