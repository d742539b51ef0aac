"""Queries of chunking, page blocks and the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import chunks as ck
from docquarry.operators import graph as op
from docquarry.operators import retrieval
from docquarry.plans.common import Registry, single_vectors, sql_tokens, table

R = Registry()

SQL_PAGES_TOK = f"p AS (SELECT source AS doc_key, doc_id AS page_index, {sql_tokens('text')} AS tokens FROM documents)"


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_key"), F.col("doc_id").alias("page_index"), tx.tokens(F.col("text")).alias("tokens"))


@R.add(
    "t13_page_windows",
    f"""WITH {SQL_PAGES_TOK}, h AS (SELECT doc_key, page_index, CASE WHEN len(tokens) > 0 THEN tokens ELSE ['empty'] END AS tokens FROM p),
c AS (SELECT *, unnest(range(0, (greatest(0, ceil((len(tokens) - 128) / 96.0)) * 96)::BIGINT + 1, 96)) AS start FROM h)
SELECT doc_key, page_index, (start // 96)::INT AS chunk_index, start::INT AS start, md5(array_to_string(tokens[start + 1:start + 128], ' ')) AS tokens_md5, len(tokens[start + 1:start + 128])::INT AS n FROM c""",
)
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ck.page_windows(doc_pages(spark, sf_dir), ["doc_key", "page_index"], 128, 32)
    return cut.select("doc_key", "page_index", "chunk_index", "start", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), F.size("tokens").alias("n"))


SQL_CROSS = f"""WITH {SQL_PAGES_TOK}, o AS (SELECT doc_key, page_index, len(tokens) AS n, sum(len(tokens)) OVER (PARTITION BY doc_key ORDER BY page_index) - len(tokens) AS off, sum(len(tokens)) OVER (PARTITION BY doc_key) AS total FROM p),
w AS (SELECT doc_key, unnest(range(0, greatest(0, ceil((max(total) - 512) / 384.0))::BIGINT + 1)) AS chunk_index FROM o GROUP BY doc_key),
c AS (SELECT doc_key, chunk_index, page_index, greatest(0, chunk_index * 384 - off) AS first, least(n, chunk_index * 384 + 512 - off) - 1 AS last,
  row_number() OVER (PARTITION BY doc_key, chunk_index ORDER BY page_index) AS r FROM w JOIN o USING (doc_key) WHERE off < chunk_index * 384 + 512 AND off + n > chunk_index * 384)
SELECT doc_key, chunk_index, min(page_index) AS start_page, max(page_index) AS end_page, count(*) AS n_pages, sum(last - first + 1)::BIGINT AS n_tokens FROM c WHERE r <= 3 GROUP BY ALL"""


@R.add("t15_cross_page_windows", SQL_CROSS)
def cross_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir).select("doc_key", "page_index", F.size("tokens").alias("n"))
    cut = ck.cross_page_windows(pages, "doc_key", "page_index", "n", 512, 128, max_pages=3)
    return cut.groupBy("doc_key", "chunk_index").agg(F.min("page_index").alias("start_page"), F.max("page_index").alias("end_page"), F.count("*").alias("n_pages"), F.sum(F.col("last") - F.col("first") + 1).alias("n_tokens"))


@R.add(
    "t06_pages_of_words",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
w AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS word_no FROM l),
j AS (SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY word_no) AS t FROM w WHERE trim(word) <> '' GROUP BY ALL)
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY line_no)) AS text_md5 FROM j GROUP BY doc_id""",
)
def pages_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", F.lit(0).alias("block_no"), "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "word"))
    return ck.pages_of_words(words, ["doc_id"], "block_no", "line_no", "word_no", "word").select("doc_id", F.md5("text").alias("text_md5"))


@R.add(
    "t19_context_words",
    f"""WITH n AS (SELECT source, doc_id, len({sql_tokens('text')}) AS n FROM documents)
SELECT source, doc_id, least(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1000)::BIGINT AS words_before,
  least(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 1000)::BIGINT AS words_after FROM n""",
)
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(tx.tokens(F.col("text"))).alias("n"))
    return ck.context_words(items, "source", "doc_id", "n", 1000).drop("n")


@R.add(
    "t01_t02_t23_normalize",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\r\n]+', ''), '[ \t\r\n]+$', '')) AS block_md5,
md5(trim(regexp_replace(html, '[\x00-\x20\x7f\x{00A0}]+', ' ', 'g'))) AS clean_md5,
CASE WHEN length(html) > 300 THEN rtrim(substr(html, 1, 299)) || '...' ELSE html END AS abstract,
CASE WHEN length(html) > 200 THEN substr(html, 1, 136) || chr(10) || '...' || chr(10) || right(html, 59) ELSE html END AS middle FROM pages""",
)
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(tx.normalize_block(html)).alias("block_md5"), F.md5(tx.clean_text(html)).alias("clean_md5"), tx.short_abstract(html).alias("abstract"), tx.truncate_middle(html, 200).alias("middle")
    )


@R.add(
    "t25_t26_keys_and_markup",
    """SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '(?i)\\.pdf$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'document') AS doc_key,
right(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), 120) AS edge_slug, '<page id="' || page_id || '">' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</page>' AS xml FROM pages""",
)
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.document_key(url).alias("doc_key"), tx.slug(url).alias("edge_slug"), tx.xml_block("page", url, id=F.col("page_id")).alias("xml"))


#: Five pages a document. Elements are tags with the text right after them; boxes and title levels follow the index.
SQL_BLOCKS = r"""raw AS (SELECT 'd' || (page_id // 5) AS doc_key, (page_id % 5)::INT AS page_index, regexp_extract_all(html, '<(?:h1|p|li|nav|footer)[ >][^<]*') AS tags FROM pages),
tags AS (SELECT doc_key, page_index, unnest(tags) AS tag, generate_subscripts(tags, 1)::INT - 1 AS block_index FROM raw),
blocks AS (SELECT doc_key, page_index, block_index, CASE WHEN starts_with(tag, '<nav') THEN 'nav' WHEN starts_with(tag, '<footer') THEN 'footer' WHEN starts_with(tag, '<li') THEN 'list' WHEN starts_with(tag, '<h1') OR block_index % 4 = 0 THEN 'title' ELSE 'paragraph' END AS type,
  1 + block_index % 3 AS level, (block_index * 37) % 600 AS x0, (block_index * 53) % 900 AS y0, (block_index * 37) % 600 + 100 + (block_index * 17) % 200 AS x1, (block_index * 53) % 900 + 20 + (block_index * 29) % 100 AS y1, tag FROM tags),
nodes AS (SELECT *, row_number() OVER (PARTITION BY doc_key, page_index ORDER BY block_index) - 1 AS element_index, doc_key || ':page:' || page_index || ':block:' || block_index || ':' || type AS id FROM blocks WHERE type NOT IN ('nav', 'footer')),
pnodes AS (SELECT DISTINCT doc_key, page_index, doc_key || ':page:' || page_index AS id FROM raw)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("d"), F.floor(F.col("page_id") / 5).cast("string")).alias("doc_key"),
        (F.col("page_id") % 5).cast("int").alias("page_index"),
        F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h1|p|li|nav|footer)[ >][^<]*"), F.lit(0))).alias("block_index", "tag"),
    )
    i = F.col("block_index")
    kind = F.when(F.startswith("tag", F.lit("<nav")), "nav").when(F.startswith("tag", F.lit("<footer")), "footer").when(F.startswith("tag", F.lit("<li")), "list")
    kind = kind.when(F.startswith("tag", F.lit("<h1")) | (i % 4 == 0), "title").otherwise("paragraph")
    x0, y0 = (i * 37) % 600, (i * 53) % 900
    return raw.withColumns({"type": kind, "level": 1 + i % 3, "x0": x0, "y0": y0, "x1": x0 + 100 + (i * 17) % 200, "y1": y0 + 20 + (i * 29) % 100})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.element_nodes(blocks(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page_nodes(table(spark, sf_dir, "pages").select(F.concat(F.lit("d"), F.floor(F.col("page_id") / 5).cast("string")).alias("doc_key"), (F.col("page_id") % 5).cast("int").alias("page_index")))


@R.add("g01_g03_element_nodes", f"WITH {SQL_BLOCKS} SELECT id, doc_key, page_index, block_index, element_index::INT AS element_index, type, level FROM nodes")
def element_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", "doc_key", "page_index", "block_index", "element_index", "type", "level")


@R.add("g04_j08_containment", f"WITH {SQL_BLOCKS} SELECT n.doc_key, p.id AS source, n.id AS target, 'contains' AS relation, (greatest(1, x1 - x0) * greatest(1, y1 - y0))::DOUBLE AS weight FROM nodes n JOIN pnodes p USING (doc_key, page_index)")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.containment(pages(spark, sf_dir), nodes(spark, sf_dir))


@R.add("g05_page_order", f"WITH {SQL_BLOCKS}, l AS (SELECT doc_key, id AS source, lead(id) OVER (PARTITION BY doc_key ORDER BY page_index) AS target FROM pnodes) SELECT *, 'next' AS relation, 1.0::DOUBLE AS weight FROM l WHERE target IS NOT NULL")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reading_order(pages(spark, sf_dir), ["page_index"])


@R.add("g06_element_order", f"WITH {SQL_BLOCKS}, l AS (SELECT doc_key, id AS source, lead(id) OVER (PARTITION BY doc_key ORDER BY page_index, element_index) AS target FROM nodes) SELECT *, 'next' AS relation, 1.0::DOUBLE AS weight FROM l WHERE target IS NOT NULL")
def element_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reading_order(nodes(spark, sf_dir), ["page_index", "element_index"])


SQL_LAYOUT = f"""{SQL_BLOCKS}, pr AS (SELECT a.doc_key, a.id AS source, b.id AS target, CASE WHEN a.x1 <= b.x0 THEN 'right_of' ELSE 'left_of' END AS relation, b.block_index AS bi,
  sqrt(pow((a.x0 + a.x1 - b.x0 - b.x1) / 2.0, 2) + pow((a.y0 + a.y1 - b.y0 - b.y1) / 2.0, 2)) AS d FROM nodes a JOIN nodes b USING (doc_key, page_index)
  WHERE a.id <> b.id AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (a.x1 <= b.x0 OR b.x1 <= a.x0)),
layout AS (SELECT doc_key, source, target, relation, 1 / (1 + d) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(d, 9), bi) AS r FROM pr) WHERE r <= 2)"""


@R.add("g07_j09_layout", f"WITH {SQL_LAYOUT} SELECT doc_key, source, target, relation, round(weight, 6) AS weight FROM layout")
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.layout(nodes(spark, sf_dir), 2).withColumn("weight", F.round("weight", 6))


SQL_SECTIONS = """tl AS (SELECT * FROM nodes WHERE type = 'title'),
up AS (SELECT a.doc_key, a.id AS target, arg_max(b.id, b.block_index) AS source FROM tl a JOIN tl b ON a.doc_key = b.doc_key AND a.page_index = b.page_index AND b.block_index < a.block_index AND b.level < a.level GROUP BY ALL),
bl AS (SELECT doc_key, id AS target, type, last_value(CASE WHEN type = 'title' THEN id END IGNORE NULLS) OVER (PARTITION BY doc_key, page_index ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS source FROM nodes),
sections AS (SELECT doc_key, source, target, 'section' AS relation FROM up UNION ALL SELECT doc_key, source, target, 'section' FROM bl WHERE type <> 'title' AND source IS NOT NULL)"""


@R.add("g08_sections", f"WITH {SQL_BLOCKS}, {SQL_SECTIONS} SELECT doc_key, source, target, relation FROM sections")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sections(nodes(spark, sf_dir))


@R.add(
    "g09_j10_semantic_neighbours",
    """WITH q AS (SELECT vec_id AS source, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0), t AS (SELECT vec_id AS target, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT source, target, list_cosine_similarity(q.v, t.v) AS weight FROM q JOIN t ON q.label = t.label AND source <> target),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 9) DESC, target) - 1 AS rank FROM s)
SELECT source, target, rank::INT AS rank, round(weight, 6) AS weight FROM r WHERE rank < 5""",
)
def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest nodes of each queried node within its layer (label), itself left out; ranks from 0."""
    vectors = single_vectors(spark, sf_dir)
    queries = vectors.where("page_id % 50 = 0").withColumnRenamed("page_id", "query_id")
    near = retrieval.vector_top_k(queries, vectors, 5, mean=True, same_group=True, skip_self=True)
    return near.select(F.col("query_id").alias("source"), F.col("page_id").alias("target"), (F.col("rank") - 1).alias("rank"), F.round("score", 6).alias("weight"))


SQL_EDGES = f"""{SQL_LAYOUT}, {SQL_SECTIONS}, edges AS (SELECT doc_key, source, target, relation, 'layout' AS type FROM layout UNION ALL SELECT doc_key, source, target, relation, 'hierarchy' FROM sections)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    found = op.layout(n, 2).select("doc_key", "source", "target", "relation", F.lit("layout").alias("type"))
    return found.unionByName(op.sections(n).withColumn("type", F.lit("hierarchy"))).withColumn("ord", F.concat_ws("|", "source", "target", "relation"))


@R.add(
    "g10_edge_ids",
    f"""WITH {SQL_EDGES}, k AS (SELECT *, concat_ws(':', 'edge', type, relation, right(regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g'), 120), right(regexp_replace(target, '[^A-Za-z0-9]+', '_', 'g'), 120)) AS key FROM edges)
SELECT source, target, relation, type, key || ':' || (row_number() OVER (PARTITION BY key ORDER BY source || '|' || target || '|' || relation) - 1) AS id FROM k""",
)
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.edge_ids(edges(spark, sf_dir), "ord").select("source", "target", "relation", "type", "id")


@R.add(
    "g11_adjacency",
    f"""WITH {SQL_EDGES}, o AS (SELECT source AS node, string_agg(target || relation, ',' ORDER BY source || '|' || target || '|' || relation) AS out_ends, count(*) AS n_out FROM edges GROUP BY source),
i AS (SELECT target AS node, string_agg(source || relation, ',' ORDER BY source || '|' || target || '|' || relation) AS in_ends, count(*) AS n_in FROM edges GROUP BY target)
SELECT node, coalesce(out_ends, '') AS out_ends, coalesce(in_ends, '') AS in_ends, coalesce(n_out, 0)::INT AS n_out, coalesce(n_in, 0)::INT AS n_in FROM o FULL JOIN i USING (node)""",
)
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    out = op.adjacency(e.withColumn("id", F.concat("target", "relation")), "ord").select("node", "out_edges")
    into = op.adjacency(e.withColumn("id", F.concat("source", "relation")), "ord").select("node", "in_edges")
    both = out.join(into, "node")
    return both.select("node", F.array_join("out_edges", ",").alias("out_ends"), F.array_join("in_edges", ",").alias("in_ends"), F.size("out_edges").alias("n_out"), F.size("in_edges").alias("n_in"))


@R.add("g12_g13_graph_stats", f"WITH {SQL_EDGES} SELECT 'node' AS kind, type, '' AS relation, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, relation, count(*) FROM edges GROUP BY type, relation")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", F.lit("").alias("relation"), "n")
    return n.unionByName(edges(spark, sf_dir).groupBy("type", "relation").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "relation", "n"))


@R.add(
    "g14_j11_integrity",
    f"""WITH {SQL_EDGES}, few AS (SELECT id FROM nodes WHERE type <> 'list') SELECT 'source' AS missing, relation, count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM few) GROUP BY ALL
UNION ALL SELECT 'target', relation, count(*) FROM edges WHERE target NOT IN (SELECT id FROM few) GROUP BY ALL UNION ALL SELECT 'duplicate', '', count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)""",
)
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are missing once list nodes are gone, and node ids that aren't unique."""
    n = nodes(spark, sf_dir)
    lost = op.dangling(edges(spark, sf_dir), n.where("type <> 'list'")).groupBy("missing", "relation").agg(F.count("*").alias("n"))
    twice = n.groupBy("id").count().where("count > 1").agg(F.lit("duplicate").alias("missing"), F.lit("").alias("relation"), F.count("*").alias("n"))
    return lost.unionByName(twice)


@R.add(
    "p08_j11_usable_edges",
    f"""WITH {SQL_EDGES}, few AS (SELECT id FROM nodes WHERE type <> 'list'), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY source || '|' || target || '|' || relation) AS n FROM edges
  WHERE relation IN ('right_of', 'section') AND source IN (SELECT id FROM few) AND target IN (SELECT id FROM few)) SELECT source, target, relation FROM k WHERE n <= 2""",
)
def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("type <> 'list'")
    return op.usable_edges(edges(spark, sf_dir), n, ["right_of", "section"], 2, "ord").select("source", "target", "relation")


@R.add(
    "j12_followed_edges",
    f"""WITH {SQL_EDGES}, f AS (SELECT doc_key, id FROM nodes WHERE type = 'title'), s AS (SELECT source AS s, target AS t, relation FROM edges UNION ALL SELECT target, source, relation FROM edges),
e AS (SELECT f.doc_key, s AS from_node, t AS id, relation FROM f JOIN s ON f.id = s.s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY relation, from_node, id) AS rank FROM (SELECT DISTINCT * FROM e))
SELECT doc_key, from_node, id, relation, rank::INT AS rank FROM r WHERE rank <= 6""",
)
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop from each document's titles, both ways, the first six by relation and ids."""
    frontier = nodes(spark, sf_dir).where("type = 'title'").select("doc_key", "id")
    steps = op.follow(frontier, edges(spark, sf_dir), "doc_key", "id").distinct()
    return retrieval.top_k(steps, ["doc_key"], [F.col("relation"), F.col("from_node"), F.col("id")], 6)


@R.add(
    "j07_restore_abstracts",
    f"""WITH {SQL_BLOCKS}, o AS (SELECT id, CASE WHEN block_index % 3 = 0 THEN '' ELSE 'old ' || id END AS abstract FROM nodes WHERE page_index < 3)
SELECT nodes.id, coalesce(nullif(o.abstract, ''), 'new ' || nodes.id) AS abstract FROM nodes LEFT JOIN o USING (id)""",
)
def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    old = n.where("page_index < 3").select("id", F.when(F.col("block_index") % 3 == 0, "").otherwise(F.concat(F.lit("old "), "id")).alias("abstract"))
    return op.restore_abstracts(n.select("id", F.concat(F.lit("new "), "id").alias("abstract")), old)
