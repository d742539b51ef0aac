"""Queries of block text, masks, relevance and checks of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import blocks as op
from docquarry.operators import indexes, retrieval
from docquarry.plans.common import Registry, table
from docquarry.plans.graph import SQL_BLOCKS, nodes

R = Registry()


@R.add("t03_span_text", "SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN '$' || p_type || '$' ELSE p_type END || p_name AS text FROM part")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda kind, c: F.struct(kind.alias("kind"), F.col(c).alias("content"))
    kind = F.when(F.col("p_size") % 2 == 0, "equation_inline").otherwise("text")
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", op.span_text(F.array(span(F.lit("text"), "p_brand"), span(kind, "p_type"), span(F.lit("text"), "p_name"))).alias("text"))


@R.add(
    "t04_block_text",
    """WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS c, p_name AS b, p_type AS f FROM part)
SELECT p_partkey, CASE kind WHEN 'image' THEN concat_ws(chr(10), b, nullif(c, ''), f) WHEN 'table' THEN concat_ws(chr(10), nullif(c, ''), b, f) ELSE b END AS text FROM p""",
)
def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "image").when(size % 3 == 1, "table").otherwise("paragraph")
    return table(spark, sf_dir, "part").select("p_partkey", op.block_text(kind, F.when(size % 5 == 0, "").otherwise(F.col("p_brand")), F.col("p_name"), F.col("p_type")).alias("text"))


@R.add("p01_p03_page_masks", """SELECT p_partkey, array_to_string(range(0, least(p_size, 12)), ',') AS allowed, array_to_string(list_sort(list_distinct(list_filter([p_size - 3, 2, p_size, 2, 40], lambda x: x >= 0 AND x < p_size))), ',') AS clipped,
list_has_any([p_size, p_size + 1], [3, 9]) AS as_set, len(list_filter([p_size, p_size + 1], lambda x: x BETWEEN 3 AND 9)) > 0 AS as_range FROM part""")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    show = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    covered, mask = F.array(n, n + 1), F.array(F.lit(3), F.lit(9))
    numbers = F.array(n - 3, F.lit(2), n, F.lit(2), F.lit(40))
    return table(spark, sf_dir, "part").select("p_partkey", show(op.allowed_pages(n, 12)).alias("allowed"), show(op.clipped_pages(numbers, n)).alias("clipped"), op.in_mask(covered, mask).alias("as_set"), op.in_mask(covered, mask, True).alias("as_range"))


@R.add("t27_templates", "SELECT c_custkey, 'Dear ' || c_name || ', you owe ' || c_nationkey || '.' AS letter FROM customer")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", op.fill_template("Dear <who>, you owe <sum>.", {"who": F.col("c_name"), "sum": F.col("c_nationkey")}).alias("letter"))


@R.add(
    "j16_j18_missing_artifacts",
    """SELECT c_custkey AS key, concat_ws(',', CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'open' END, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'filled' END) AS missing
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    found = op.missing_artifacts(samples, "key", {"open": orders.where("o_orderstatus = 'O'"), "filled": orders.where("o_orderstatus = 'F'")})
    return found.select("key", F.array_join("missing", ",").alias("missing"))


@R.add("j13_gold_pages", "SELECT user_id, bool_or(event_type = 'purchase' AND event_id % 3 = 0) AS hit, count_if(event_type = 'purchase') AS n_gold FROM events GROUP BY user_id")
def gold_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether retrieved pages (every third event) meet the gold ones (purchases)."""
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).alias("got"), F.collect_set(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("gold"))
    return sets.select("user_id", F.arrays_overlap("got", "gold").alias("hit"), F.size("gold").cast("long").alias("n_gold"))


@R.add("m06_retrieval_summary", """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), f AS (SELECT user_id, min(rank) FILTER (event_type = 'purchase') AS first_hit FROM r GROUP BY user_id)
SELECT round(avg(CASE WHEN first_hit <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(first_hit) FILTER (first_hit <= 5), 6) AS mean_rank FROM f""")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")))
    first = ranked.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("rank"))).alias("first_hit"))
    hit = F.coalesce(F.col("first_hit") <= 5, F.lit(False))
    return first.agg(F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.when(hit, F.col("first_hit"))), 6).alias("mean_rank"))


@R.add("m39_trace_index", "SELECT user_id, coalesce(nullif(count_if(event_type = 'click'), 0), count(DISTINCT event_type)) AS n FROM events GROUP BY user_id")
def trace_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = F.count_if(F.col("event_type") == "click")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.nullif(clicks, F.lit(0)), F.countDistinct("event_type")).alias("n"))


@R.add("a17_max_over_golds", "SELECT user_id, event_type, round(max(value), 6) AS best, count(*) AS golds FROM events GROUP BY ALL")
def max_over_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("best"), F.count("*").alias("golds"))


@R.add("p13_p12_filters", "SELECT doc_id FROM documents WHERE (lang = 'en' OR source = 'src1') AND contains(lower(source || ' ' || lang || ' ' || text), 'the ')")
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modality and free-text filters over concatenated columns."""
    rows = table(spark, sf_dir, "documents").where((F.col("lang") == "en") | (F.col("source") == "src1"))
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "source", "lang", "text")), F.lit("the "))).select("doc_id")


@R.add("a12_extraction", """SELECT conv_id, turn, trim(regexp_extract('Answer: ' || text || chr(10) || 'Format: ' || role, 'Answer:\\s*([^\\n]*)', 1)) AS answer, trim(regexp_extract('Answer: ' || text || chr(10) || 'Format: ' || role, 'Format:\\s*([^\\n]*)', 1)) AS format FROM conversations""")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer and format of an extraction's text."""
    said = F.concat(F.lit("Answer: "), "text", F.lit("\nFormat: "), "role")
    part = lambda name: F.btrim(F.regexp_extract(said, rf"{name}:\s*([^\n]*)", 1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", part("Answer").alias("answer"), part("Format").alias("format"))


@R.add(
    "p12_text_search",
    """WITH n AS (SELECT item_id, lower(left(text, 20)) AS needle FROM benchmark WHERE text <> ''), h AS (SELECT doc_id, lower(text) AS h FROM documents)
SELECT item_id, doc_id, ((length(h) - length(replace(h, needle, ''))) // length(needle))::BIGINT AS n FROM n JOIN h ON contains(h, needle)""",
)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search box for each benchmark item: the documents that hold its first twenty characters, in any case."""
    needles = table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.lit("").alias("corpus"), F.lower(F.substring("text", 1, 20)).alias("term"))
    docs = table(spark, sf_dir, "documents").select(F.lit("").alias("corpus"), "doc_id", F.lower("text").alias("h"))
    return needles.join(indexes.substring_counts(docs, needles.select("corpus", "term"), "doc_id"), ["corpus", "term"]).select("item_id", "doc_id", "n")
