"""Queries of plans, note links, balanced bins, prompts cut to a budget, streams of records, table functions and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import tables
from docquarry.functions import text as tx
from docquarry.operators import balance, dags, notes
from docquarry.plans.agent import SQL_REPLAY, trace
from docquarry.plans.common import Registry, table
from docquarry.plans.ingest import R as INGEST
from docquarry.plans.metrics import SQL_COMPACT, records
from docquarry.sources import datasets
from docquarry.sources.scratch import scratch_path
from docquarry.streaming import keyed

R = Registry()


@R.add("m35_karmarkar_karp")
def karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight bins by largest differencing: a test holds the spread to that of greedy dealing."""
    dealt = balance.karmarkar_karp(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8)
    return dealt.groupBy("bin").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))


@R.add(
    "c19_execution_order",
    """WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS size FROM part)
SELECT p_brand, p_partkey, (i - 1)::INT AS position, CASE WHEN ends_with(p_brand, '5') THEN NULL ELSE floor(log2(i))::INT END AS level, ((2 * i > size)::INT + (2 * i + 1 > size)::INT)::INT AS n_unknown,
  NOT ends_with(p_brand, '5') AS valid FROM n""",
)
def execution_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand as a plan: its i-th part asks its 2i-th and its next; those of brands on 5 come back to the first."""
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", i.alias("i"))
    back = F.when(F.col("p_brand").endswith("5") & (F.col("i") == 1), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    asked = rows.select("p_brand", "p_partkey", F.col("i").alias("ordinal"), F.col("i").alias("node"), F.concat(F.array(2 * F.col("i"), 2 * F.col("i") + 1), back).alias("children"))
    names = rows.select(F.col("p_brand").alias("b"), F.col("i").alias("n"), "p_partkey")
    found = dags.execution_order(asked, "p_brand").join(names, (F.col("p_brand") == F.col("b")) & (F.col("node") == F.col("n")))
    return found.select("p_brand", "p_partkey", "position", "level", F.size("unknown").alias("n_unknown"), "valid")


@R.add(
    "r29_note_links",
    """WITH s AS (SELECT q.vec_id AS note_id, p.vec_id AS earlier, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings p ON p.vec_id < q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, earlier) AS rank FROM s) SELECT note_id, earlier, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector a note, linked to its five nearest earlier ones."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), F.col("embedding").alias("vec"))
    return notes.earlier_links(rows).withColumn("score", F.round("score", 6))


@R.add("t22_fitted_prompts")
def fitted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut in their middle to a budget of tokens: a test holds them to counting each try."""
    budget = 40 + F.col("doc_id") % 200
    got = table(spark, sf_dir, "documents").select("doc_id", budget.alias("budget"), tx.fitted_prompt("text", budget).alias("p"))
    return got.select("doc_id", "budget", "p.n_tokens", "p.truncated", F.md5("p.content").alias("content_md5"))


def _arriving(rows: DataFrame, last: dict, path: str) -> DataFrame:
    """The rows as a stream of files, and after them one row that takes the watermark past all of them."""
    rows.write.parquet(f"{path}/in/rows")
    rows.sparkSession.range(1).select(*[F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.parquet(f"{path}/in/last")
    return rows.sparkSession.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")


@R.add("x_stream_compact", f"WITH {SQL_COMPACT} SELECT question, line, first_line, round(score, 6) AS score FROM k WHERE r = 1")
def stream_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the last good record of each question from a stream of records."""
    path = scratch_path(spark, "stream-compact")
    rows = records(spark, sf_dir).select("question", "line", "status", "score", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line") % 86_400).alias("at"))
    stream = _arriving(rows, {"question": -1, "line": 0, "status": "O", "at": "2100-01-01"}, path)
    found = keyed.drain_appends(spark, keyed.last_good(stream, "question", "line", F.col("status") != "F", "at", late="2 days"), path)
    return found.where("question >= 0").select("question", "line", "first_line", F.round("score", 6).alias("score"))


@R.add("x_stream_state_machine", f"WITH RECURSIVE {SQL_REPLAY} SELECT user_id, page, array_to_string(states, ',') AS states, n_actions, n_refused FROM r")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: traces replayed from a stream of actions, one at a time against the state held for their page."""
    path = scratch_path(spark, "stream-states")
    stream = _arriving(trace(spark, sf_dir), {"user_id": -1, "page": 0, "node": 0, "ts": "2100-01-01", "event_id": -1, "action": "look", "allowed": True}, path)
    found = keyed.drain_appends(spark, keyed.state_machine(stream, ["user_id", "page"], ["ts", "event_id"], 5, late="3650 days"), path)
    last = found.where("user_id >= 0").groupBy("user_id", "page").agg(F.max_by(F.struct("states", "n_actions", "n_refused"), "n_actions").alias("x"))
    return last.select("user_id", "page", F.array_join("x.states", ",").alias("states"), "x.n_actions", "x.n_refused")


@R.add("x_sql_text_pieces", INGEST.sql["t17_t20_split_pieces"])
def sql_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: pieces of texts by a table function in SQL."""
    tables.register(spark)
    name = "docquarry_documents"
    table(spark, sf_dir, "documents").createOrReplaceTempView(name)
    return spark.sql(f"SELECT doc_id, piece, length(content) AS n_chars, md5(content) AS content_md5 FROM text_pieces(TABLE(SELECT doc_id, text FROM {name}), 'doc_id', 'text', 1000, 100)")


@R.add("s14_s15_rankings_format", "SELECT 'q' || (vec_id % 20) AS query, 'd' || vec_id AS doc, (vec_id // 20 + 1)::INT AS rank, vec_id / 8.0::DOUBLE AS score, 'run' AS tag, label::VARCHAR AS label FROM embeddings WHERE label IN (1, 4) AND vec_id % 20 < 10")
def rankings_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings written as lines in a folder for each label, and some of them read as a dataset format: other folders aren't opened."""
    datasets.register(spark)
    path, i = scratch_path(spark, "rankings"), F.col("vec_id")
    line = F.concat_ws(" ", F.concat(F.lit("q"), (i % 20).cast("string")), F.lit("Q0"), F.concat(F.lit("d"), i.cast("string")), (F.floor(i / 20) + 1).cast("string"), (i / 8.0).cast("string"), F.lit("run"))
    table(spark, sf_dir, "embeddings").select(line.alias("value"), "label").write.partitionBy("label").text(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("trec_run").load(path).where(F.col("label").isin("1", "4") & F.col("query").isin(*[f"q{n}" for n in range(10)]))


@R.add("k10_memory_round_trip", "SELECT vec_id AS note_id, 'label ' || label AS content, [label::VARCHAR, 'k'] AS keywords, [vec_id - 1] AS links, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def memory_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and their vectors saved as a memory, and read back."""
    path, rows = scratch_path(spark, "memory"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "note_id")
    label = F.col("label").cast("string")
    made = rows.select("note_id", F.concat(F.lit("label "), label).alias("content"), F.array(label, F.lit("k")).alias("keywords"), F.array(F.col("note_id") - 1).alias("links"))
    notes.save_memory(made, rows.select("note_id", F.col("embedding").alias("vec")), path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return notes.load_memory(spark, path).select("note_id", "content", "keywords", "links", F.round(total, 6).alias("total"))
