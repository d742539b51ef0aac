"""Queries of sources, page texts, sample selection, manifests and the approximate index."""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import literals as lt
from docquarry.functions import text as tx
from docquarry.operators import blocks as bl
from docquarry.operators import chunks as ck
from docquarry.operators import indexes, retrieval
from docquarry.operators import samples as op
from docquarry.plans.agent import SQL_STATED, stated, structure
from docquarry.plans.common import Registry, asked, single_vectors, sql_tokens, table
from docquarry.plans.graph import SQL_BLOCKS, SQL_PAGES_TOK, blocks, doc_pages
from docquarry.sources import files
from docquarry.sources.scratch import scratch_path

R = Registry()


@R.add("s01_json_arrays", "SELECT c_custkey AS sample_id, c_name AS name, c_nationkey AS nation FROM customer")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in files that hold one JSON array each, a file a nation."""
    path = scratch_path(spark, "arrays")
    rows = table(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("s"), "c_nationkey")
    rows.groupBy("c_nationkey").agg(F.to_json(F.collect_list("s")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json_array(spark, path, "sample_id bigint, name string, nation int")


@R.add("s04_strict_lines", "SELECT event_id, event_type FROM events")
def strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which a malformed one fails the read."""
    path = scratch_path(spark, "strict")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return files.read_jsonl(spark, path, "event_id bigint, event_type string", strict=True)


SQL_FILES = """fl AS (SELECT doc_key, CASE WHEN page_id % 7 = 0 THEN 'content_list.json' ELSE 'x' || page_id || CASE WHEN page_id % 3 = 0 THEN '.md' ELSE '_content_list.json' END END AS name FROM (SELECT page_id, page_id // 4 AS doc_key FROM pages))"""


@R.add("s06_content_files", f"WITH {SQL_FILES} SELECT doc_key, coalesce(max(name) FILTER (name = 'content_list.json'), min(name)) AS name FROM fl WHERE name = 'content_list.json' OR ends_with(name, '_content_list.json') GROUP BY doc_key")
def content_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    other = F.concat(F.lit("x"), page.cast("string"), F.when(page % 3 == 0, ".md").otherwise("_content_list.json"))
    listed = table(spark, sf_dir, "pages").select(F.floor(page / 4).alias("doc_key"), F.when(page % 7 == 0, "content_list.json").otherwise(other).alias("name"))
    return op.content_file(listed, "doc_key", "name", "content_list.json", "_content_list.json")


@R.add(
    "s09_word_pages",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents),
w AS (SELECT doc_id, page, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS k FROM l WHERE page < 4),
j AS (SELECT doc_id, page, string_agg(word, ' ' ORDER BY k) AS t FROM w WHERE trim(word) <> '' GROUP BY ALL)
SELECT doc_id, page::INT AS page, md5(coalesce(nullif(trim(t), ''), '[EMPTY PAGE]')) AS text_md5 FROM l LEFT JOIN j USING (doc_id, page) WHERE page < 4""",
)
def word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages of words, the first four of each document; a page without words says so."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    words = lines.select("doc_id", "page", F.lit(0).alias("block"), F.lit(0).alias("line_no"), F.posexplode(F.split("line", " ")).alias("k", "word"))
    return ck.masked_pages(lines.select("doc_id", "page"), words, ["doc_id"], "page", 4, "block", "line_no", "k", "word").select("doc_id", "page", F.md5("text").alias("text_md5"))


@R.add("s11_checked_vectors", "SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read with a check of their length."""
    rows = op.checked_vectors(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@R.add("s15_dataset_records", "SELECT p_partkey::VARCHAR AS id, 'Title: ' || p_name || ' Text: ' || p_type AS record FROM part")
def dataset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated records read back and put into a template; partitions are the shards."""
    path = scratch_path(spark, "tsv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").write.csv(path, sep="\t", header=True)
    rows = files.read_records(spark, path, "id string, title string, text string")
    return rows.select("id", bl.fill_template("Title: <title> Text: <text>", {"title": F.col("title"), "text": F.col("text")}).alias("record"))


@R.add(
    "s18_id_url_mapping",
    """WITH x AS (SELECT user_id AS id, 'http://a/' || event_id AS url, 0 AS src, event_id AS line FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'http://b/' || event_id END, 1, event_id FROM events WHERE event_type = 'click')
SELECT id::VARCHAR AS id, arg_max(url, src * 1000000000 + line) AS url FROM x WHERE url IS NOT NULL GROUP BY id""",
)
def id_url_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of ids and URLs: the later list wins, and in a list the last line; rows without a URL don't count."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("line"), "event_type")
    one = events.where("event_type = 'view'").withColumn("url", F.concat(F.lit("http://a/"), F.col("line").cast("string")))
    two = events.where("event_type = 'click'").withColumn("url", F.when(F.col("line") % 2 == 0, F.concat(F.lit("http://b/"), F.col("line").cast("string"))))
    return op.latest_mapping([one, two])


@R.add("k05_csv_report", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report table written as CSV and read again."""
    path = scratch_path(spark, "report")
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    rows.write.csv(path, header=True)
    return spark.read.schema("segment string, n bigint, mean double").csv(path, header=True)


@R.add("k06_result_names", "SELECT p_partkey, 'res_top_k_' || p_size || '_mode_' || trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_') || '_' || trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_') || '.jsonl' AS name FROM part")
def result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of runs from their parameters and model."""
    return table(spark, sf_dir, "part").select("p_partkey", files.result_name({"top_k": F.col("p_size"), "mode": F.col("p_type")}, F.col("p_name")).alias("name"))


@R.add(
    "k07_run_manifest",
    """SELECT c_nationkey AS benchmark, '{"runs":' || count(DISTINCT c_mktsegment) || ',"customers":' || count(*) || ',"warnings":[' || CASE WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN '"negative balances"' ELSE '' END || ']}' AS manifest FROM customer GROUP BY 1""",
)
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each benchmark's runs as JSON."""
    sums = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("benchmark")).agg(F.countDistinct("c_mktsegment").alias("runs"), F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("low"))
    warnings = F.filter(F.array(F.when(F.col("low") > 0, F.lit("negative balances"))), lambda x: x.isNotNull())
    return sums.select("benchmark", F.to_json(F.struct("runs", "customers", warnings.alias("warnings"))).alias("manifest"))


@R.add("k08_cache_variants", "SELECT p_partkey, 'ckpt_' || coalesce(nullif(trim(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'checkpoint') || '_chunk_size_' || p_size || '_cross_' || (p_size % 2 = 0) AS variant FROM part")
def cache_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = op.cache_variant({"ckpt": F.concat(F.lit("models/x/"), "p_name"), "chunk_size": F.col("p_size"), "cross": F.col("p_size") % 2 == 0})
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("variant"))


SQL_JOBS = """rc AS (SELECT page_id AS line, CASE WHEN page_id % 2 = 0 THEN 'm' ELSE 'l' END AS benchmark, 'docs/' || regexp_extract(url, '://([^/]*)', 1) || '.PDF' AS main_doc FROM pages),
jb AS (SELECT 'mem_' || benchmark || '_doc_' || regexp_extract(main_doc, 'docs/(.*)\\.PDF', 1) AS memory_id, min(line) AS line FROM rc GROUP BY 1)"""


@R.add("k09_k10_ready_jobs", f"WITH {SQL_JOBS} SELECT memory_id, line, line % 2 = 0 AND line % 3 = 0 AS is_ready FROM jb")
def ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job a document, its first record's, and whether both of its files are there."""
    host = F.regexp_extract("url", "://([^/]*)", 1)
    records = table(spark, sf_dir, "pages").select(F.col("page_id").alias("line"), F.when(F.col("page_id") % 2 == 0, "m").otherwise("l").alias("benchmark"), F.concat(F.lit("docs/"), host, F.lit(".PDF")).alias("main_doc"))
    jobs = op.memory_jobs(records, "line").select("memory_id", "line")
    done = op.ready(jobs, [jobs.where("line % 2 = 0"), jobs.where("line % 3 = 0")], "memory_id").select(F.col("memory_id").alias("done"))
    return jobs.join(done, F.col("memory_id") == F.col("done"), "left").select("memory_id", "line", F.col("done").isNotNull().alias("is_ready"))


SQL_LOG = """lg AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'pdf' ELSE 'question' END AS kind, user_id::VARCHAR AS key, CASE WHEN event_type = 'purchase' THEN 'failed' ELSE 'ok' END AS status, event_id AS line FROM events),
ls AS (SELECT kind, key FROM lg GROUP BY kind, key HAVING arg_max(status, line) = 'failed')"""
SQL_SAMPLES = "sm AS (SELECT c_custkey AS question_id, (c_custkey * 7 % 500)::VARCHAR || CASE WHEN c_custkey % 2 = 0 THEN '.pdf' ELSE '' END AS doc_id FROM customer)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("question_id"), F.concat((key * 7 % 500).cast("string"), F.when(key % 2 == 0, ".pdf").otherwise("")).alias("doc_id"))


def _failed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    event = F.col("event_id")
    log = table(spark, sf_dir, "events").select(F.when(event % 2 == 0, "pdf").otherwise("question").alias("kind"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "purchase", "failed").otherwise("ok").alias("status"), event.alias("at"))
    return op.failed_keys(log, kind)


@R.add("k11_failed_keys", f"WITH {SQL_LOG} SELECT kind, key FROM ls")
def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to try again: keys whose latest entry is a failure."""
    both = [_failed(spark, sf_dir, k).select(F.lit(k).alias("kind"), "key") for k in ("pdf", "question")]
    return both[0].unionByName(both[1])


@R.add("p05_first_samples", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred samples: the limit is the operator."""
    return op.first_samples(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100)


SQL_LISTED = "listed AS (SELECT *, doc_id IN (SELECT key FROM ls WHERE kind = 'pdf') OR regexp_replace(doc_id, '(?i)\\.pdf$', '') IN (SELECT key FROM ls WHERE kind = 'pdf') AS d, question_id::VARCHAR IN (SELECT key FROM ls WHERE kind = 'question') AS q FROM sm)"


@R.add("p06_selected_samples", f"WITH {SQL_LOG}, {SQL_SAMPLES}, {SQL_LISTED} SELECT question_id, doc_id FROM listed WHERE d AND q")
def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.select_samples(_samples(spark, sf_dir), _failed(spark, sf_dir, "pdf"), _failed(spark, sf_dir, "question")).select("question_id", "doc_id")


@R.add("p07_retried_samples", f"WITH {SQL_LOG}, {SQL_SAMPLES}, {SQL_LISTED} SELECT question_id, doc_id FROM listed WHERE d OR q")
def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.select_samples(_samples(spark, sf_dir), _failed(spark, sf_dir, "pdf"), _failed(spark, sf_dir, "question"), either=True).select("question_id", "doc_id")


@R.add(
    "p09_graph_modes",
    f"""WITH {SQL_STATED}, al AS (SELECT id, false AS is_page FROM n UNION ALL SELECT DISTINCT page_id, true FROM n)
SELECT 'page_only' AS mode, (SELECT count(*) FROM al WHERE is_page) AS n_nodes, 0::BIGINT AS n_edges UNION ALL SELECT 'structural_graph', (SELECT count(*) FROM al), (SELECT count(*) FROM e WHERE type IN ('section_hierarchy', 'reading_order'))
UNION ALL SELECT 'layout_graph', (SELECT count(*) FROM al), (SELECT count(*) FROM e WHERE type = 'layout') UNION ALL SELECT 'full_graph', (SELECT count(*) FROM al), (SELECT count(*) FROM e)""",
)
def graph_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the graph in each mode."""
    n = stated(spark, sf_dir)
    nodes = n.select("id", F.lit(False).alias("is_page")).unionByName(n.select(F.col("page_id").alias("id"), F.lit(True).alias("is_page")).distinct())
    edges, out = structure(spark, sf_dir), None
    for mode in ("page_only", "structural_graph", "layout_graph", "full_graph"):
        kept, links = op.graph_mode(nodes, edges, mode)
        counted = kept.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(links.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
        row = counted.agg(F.lit(mode).alias("mode"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_edges"))
        out = row if out is None else out.unionByName(row)
    return out


@R.add("p10_first_pages", f"WITH {SQL_BLOCKS} SELECT doc_key, page_index, count(*) AS n FROM blocks WHERE page_index < 3 GROUP BY ALL")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document's first three pages."""
    return op.first_pages(blocks(spark, sf_dir), "page_index", 3).groupBy("doc_key", "page_index").agg(F.count("*").alias("n"))


@R.add(
    "t07_page_prompts",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents)
SELECT doc_id, md5(chr(10) || chr(10) || string_agg('page_no: ' || (page + 1) || chr(10) || line || chr(10) || chr(10), '' ORDER BY page)) AS prompt_md5, count(*) AS n_pages FROM l WHERE page BETWEEN doc_id % 3 AND doc_id % 3 + 4 AND trim(line) <> '' GROUP BY doc_id""",
)
def page_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages: those from a start to an end number, in a template."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    first = F.col("doc_id") % 3
    chosen = pages.where((F.col("page") >= first) & (F.col("page") <= first + 4) & (F.btrim("text") != ""))
    return ck.page_prompt(chosen, ["doc_id"], "page", "text").select("doc_id", F.md5("prompt").alias("prompt_md5"), "n_pages")


@R.add("t08_flattened_items", "SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type || chr(10) || 'end' AS text FROM part")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of nested page items, the named fields in a fixed order whatever their order in the file."""
    q = lambda c: F.to_json(F.struct(F.col(c).alias("t")))
    value = lambda c: F.regexp_extract(q(c), r'^\{"t":(.*)\}$', 1)
    js = F.concat(F.lit('[{"id":1,"title":'), value("p_brand"), F.lit(',"text":" '), F.regexp_extract(value("p_name"), '^"(.*)"$', 1), F.lit(' "},{"content":[{"caption":'), value("p_type"), F.lit(',"other":"no"}]},null,"end"]'))
    return table(spark, sf_dir, "part").select("p_partkey", lt.flattened_json(js).alias("text"))


@R.add(
    "t09_page_texts",
    f"""WITH {SQL_BLOCKS}, x AS (SELECT doc_key, page_index, block_index, '[' || type || ' ' || block_index || ']' || chr(10) || trim(regexp_replace(tag, '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM blocks WHERE trim(tag, ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT doc_key, page_index, md5(regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY block_index), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5 FROM x GROUP BY ALL""",
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as ``[type index]`` and text, one page's joined by blank lines."""
    return bl.page_text(blocks(spark, sf_dir).withColumnRenamed("tag", "text"), ["doc_key", "page_index"], "block_index").select("doc_key", "page_index", F.md5("text").alias("text_md5"))


def sql_pieces(source: str, size: int, overlap: int) -> str:
    """CTEs that cut ``source(key, t)`` into pieces step by step, each after the last of the first separator found in its second half."""
    cut = "CASE " + " ".join(
        f"WHEN stop < length(t) AND contains(half, {s}) THEN stop - strpos(reverse(half), reverse({s})) + 1" for s in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")
    ) + " ELSE stop END"
    return f"""pc AS (SELECT key, t, -1 AS piece, 0 AS start, 0 AS finish, 0 AS nxt FROM {source} WHERE length(t) > 0
  UNION ALL SELECT key, t, piece + 1, nxt, ({cut})::INT, greatest(({cut})::INT - {overlap}, nxt + 1) FROM (SELECT *, least(length(t), nxt + {size})::INT AS stop, substr(t, nxt + {size // 2} + 1, least(length(t), nxt + {size}) - nxt - {size // 2}) AS half FROM pc WHERE piece < 0 OR finish < length(t)))"""


@R.add("t17_t20_split_pieces", f"WITH RECURSIVE src AS (SELECT doc_id AS key, text AS t FROM documents), {sql_pieces('src', 1000, 100)} SELECT key AS doc_id, piece, (finish - start)::INT AS n_chars, md5(substr(t, start + 1, finish - start)) AS content_md5 FROM pc WHERE piece >= 0")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = bl.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 100)
    return cut.select("doc_id", "piece", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@R.add("t18_markdown_pieces", f"WITH RECURSIVE src AS (SELECT doc_id AS key, text AS t FROM documents), {sql_pieces('src', 3000, 300)} SELECT key AS doc_id, piece, md5(substr(t, start + 1, finish - start)) AS content_md5 FROM pc WHERE piece >= 0")
def markdown_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an image link put before them: the link goes before the text is cut."""
    linked = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("![](images/x.png)"), "text").alias("text"))
    cut = bl.split_texts(bl.without_image_links(linked, "text"), "doc_id", "text", 3000, 300)
    return cut.select("doc_id", "piece", F.md5("content").alias("content_md5"))


@R.add(
    "t14_t16_token_chunks",
    f"""WITH {SQL_PAGES_TOK}, h AS (SELECT doc_key, page_index, CASE WHEN len(tokens) > 0 THEN tokens ELSE ['empty'] END AS tokens FROM p),
c AS (SELECT *, unnest(range(0, (greatest(0, ceil((len(tokens) - 200) / 150.0)) * 150)::BIGINT + 1, 150)) AS start FROM h)
SELECT doc_key, page_index, (start // 150)::INT AS chunk_index, start::INT AS first, (least(start + 200, len(tokens)) - 1)::INT AS last FROM c""",
)
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows within pages, by the place of their first and last token."""
    return ck.token_chunks(doc_pages(spark, sf_dir), "doc_key", "page_index", 200, 50, cross=False)


#: The named references of HTML and what they stand for; those that may lack their semicolon, longest first.
SQL_NAMED = ", ".join("('{}', '{}')".format(name, chars.replace("'", "''")) for name, chars in html5.items())
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))
#: Numbers that stand for another character: none, a carriage return, and those that Windows-1252 has.
SQL_RENUMBERED = ", ".join(f"({n}, {ord(unescape(f'&#{n};'))})" for n in (0, 13, *range(128, 160)))
#: ``html.unescape`` step by step: texts are cut into references and what is between them; a reference is a number, a name, or starts with a name that
#: needs no semicolon; numbers of no character are replaced or go.
SQL_UNESCAPED = rf"""named(name, chars) AS (VALUES {SQL_NAMED}), renumbered(num, code) AS (VALUES {SQL_RENUMBERED}),
cut AS (SELECT page_id, regexp_extract_all(html, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)|[^&]+|&') AS p FROM pages),
parts AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM cut),
keyed AS (SELECT *, CASE WHEN part LIKE '&_%' THEN substr(part, 2) END AS ref, CASE WHEN part LIKE '&#%' THEN ltrim(regexp_extract(part, '^&#[xX]?([0-9a-fA-F]+)', 1), '0') END AS digits FROM parts),
numbered AS (SELECT *, CASE WHEN digits = '' THEN 0 WHEN length(digits) > 8 THEN 99999999 WHEN ref ILIKE '#x%' THEN ('0x' || digits)::BIGINT ELSE digits::BIGINT END AS num, regexp_extract(ref, '^(?:{_BARE})') AS start FROM keyed),
resolved AS (SELECT page_id, i, CASE WHEN r.code IS NOT NULL THEN chr(r.code::INT) WHEN k.num BETWEEN 55296 AND 57343 OR k.num > 1114111 THEN chr(65533)
    WHEN k.num BETWEEN 1 AND 8 OR k.num = 11 OR k.num BETWEEN 14 AND 31 OR k.num BETWEEN 127 AND 159 OR k.num BETWEEN 64976 AND 65007 OR k.num % 65536 >= 65534 THEN ''
    WHEN k.num IS NOT NULL THEN chr(k.num::INT) ELSE coalesce(n.chars, b.chars || substr(part, length(start) + 2), part) END AS t
  FROM numbered k LEFT JOIN renumbered r ON r.num = k.num LEFT JOIN named n ON n.name = ref LEFT JOIN named b ON b.name = start),
unescaped AS (SELECT page_id, coalesce(string_agg(t, '' ORDER BY i), '') AS html FROM pages LEFT JOIN resolved USING (page_id) GROUP BY page_id)"""


@R.add("t01_unescaped_text", rf"""WITH {SQL_UNESCAPED} SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\r\n]+', ''), '[ \t\r\n]+$', '')) AS text_md5 FROM unescaped""")
def unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text with entities resolved."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.normalize_text(F.col("html"))).alias("text_md5"))


@R.add("p16_seeded_subset", "WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7/' || source || '/' || doc_id), doc_id) AS draw FROM documents) SELECT source, doc_id, draw::INT AS draw FROM d WHERE draw <= 5")
def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source, the same on every run: sampling is the operator."""
    return bl.seeded_subset(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 7, 5)


@R.add("r26_generation_docs", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id::VARCHAR) AS r FROM events) SELECT event_type AS qid, string_agg(event_id, ',' ORDER BY r) AS docids FROM r WHERE r <= 3 GROUP BY event_type")
def generation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = table(spark, sf_dir, "events").select(F.col("event_type").alias("qid"), F.col("event_id").cast("string").alias("docid"), F.col("value").alias("score"))
    return op.generation_docs(run, 3).select("qid", F.array_join("docids", ",").alias("docids"))


@R.add("r26_positive_docs", "SELECT page_id, 'a-b' || page_id AS by_dash, 'x' || page_id || '|y' AS by_parts FROM pages")
def positive_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the ids of queries name, in two forms of ids."""
    n = F.col("page_id").cast("string")
    dash, parts = op.positive_docs(F.concat(F.lit("a-b"), n, F.lit("-17"))), op.positive_docs(F.concat(F.lit("x"), n, F.lit("tcy6yquery_number3")), "tcy6")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(dash, "|").alias("by_dash"), F.array_join(parts, "|").alias("by_parts"))


@R.add("j15_token_owners", "SELECT event_id, vec_id AS token, vec_id // 4 AS owner FROM events JOIN embeddings ON event_id % 500 = vec_id")
def token_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on tokens, with the pages that own them."""
    tokens = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.floor(F.col("vec_id") / 4).alias("page_id"))
    hits = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500).alias("token"))
    return op.token_owners(hits, tokens).select("event_id", "token", "owner")


@R.add("r10_cell_index")
def cell_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search through cells: a test holds its recall to the exact ranking."""
    pages = single_vectors(spark, sf_dir)
    found = retrieval.cell_search(asked(pages), pages, 5, cells=16, probes=12)
    return found.select("query_id", "rank", "page_id", F.round("score", 6).alias("score"))


@R.add("r10_pq_index")
def pq_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted lists of product codes with exact re-ranking: a test holds its recall to the exact ranking."""
    pages = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vec"))
    quantiser = indexes.fit_quantiser(pages, cells=16, parts=16)
    queries = pages.where("page_id % 50 = 0").withColumnRenamed("page_id", "query_id")
    found = indexes.pq_search(queries, indexes.pq_index(pages, quantiser), pages, quantiser, 5, probes=12)
    return found.select("query_id", "rank", "page_id", F.round("score", 6).alias("score"))
