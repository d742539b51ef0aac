"""Queries of the exploration state machine: replay, candidates, expansion, and what evaluator and reader see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import blocks as bl
from docquarry.operators import controller as op
from docquarry.operators import shown
from docquarry.operators import graph as gr
from docquarry.operators import retrieval
from docquarry.plans.common import SQL_PAGES, Registry, asked, page_vectors, table
from docquarry.plans.graph import SQL_BLOCKS, SQL_LAYOUT, SQL_SECTIONS, nodes

R = Registry()

#: Events as a trace: three pages of four elements (node 0 is the page) per user, of which the first ones are allowed.
SQL_REPLAY = """a AS (SELECT user_id, (event_id % 3)::INT AS page, (event_id % 5)::INT AS node, ts, event_id, event_id % 3 <= user_id % 3 AS allowed,
  CASE event_type WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'prune' WHEN 'view' THEN 'activate' WHEN 'login' THEN 'activate' ELSE 'look' END AS action FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY ts, event_id) AS i FROM a),
f AS (SELECT user_id, page, 0::BIGINT AS i, ['Inactive', 'Inactive', 'Inactive', 'Inactive', 'Inactive'] AS s, 0 AS refused FROM (SELECT DISTINCT user_id, page FROM o)
  UNION ALL SELECT user_id, page, i, CASE WHEN NOT ok THEN s ELSE list_transform(s, lambda x, j: CASE WHEN j = node + 1 THEN new WHEN action = 'activate' AND j = 1 AND x = 'Inactive' THEN 'Active' ELSE x END) END,
    refused + CASE WHEN action <> 'look' AND NOT ok THEN 1 ELSE 0 END FROM (
    SELECT f.user_id, f.page, o.i, s, refused, node, action, CASE action WHEN 'activate' THEN 'Active' WHEN 'open' THEN 'Opened' ELSE 'Pruned' END AS new,
      CASE action WHEN 'activate' THEN allowed AND (node = 0 OR s[1] <> 'Pruned') WHEN 'open' THEN node > 0 AND s[node + 1] = 'Active' AND s[1] <> 'Pruned' WHEN 'prune' THEN s[node + 1] <> 'Pruned' ELSE false END AS ok
    FROM f JOIN o ON o.user_id = f.user_id AND o.page = f.page AND o.i = f.i + 1)),
r AS (SELECT user_id, page, arg_max(s, i) AS states, max(i)::INT AS n_actions, max(refused)::INT AS n_refused FROM f GROUP BY user_id, page)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, page = F.col("event_type"), (F.col("event_id") % 3).cast("int")
    action = F.when(kind == "click", "open").when(kind == "purchase", "prune").when(kind.isin("view", "login"), "activate").otherwise("look")
    return table(spark, sf_dir, "events").select("user_id", page.alias("page"), (F.col("event_id") % 5).cast("int").alias("node"), "ts", "event_id", action.alias("action"), (page <= F.col("user_id") % 3).alias("allowed"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.replay(trace(spark, sf_dir), ["user_id", "page"], ["ts", "event_id"], 5)


def node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, page, node, state)``: the page itself is node 0."""
    return replayed(spark, sf_dir).select("user_id", "page", F.posexplode("states").alias("node", "state"))


@R.add("c01_c04_state_replay", f"WITH RECURSIVE {SQL_REPLAY} SELECT user_id, page, array_to_string(states, ',') AS states, n_actions, n_refused FROM r")
def state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir).withColumn("states", F.array_join("states", ","))


SQL_STATES = f"{SQL_REPLAY}, st AS (SELECT user_id, page, unnest(states) AS state, unnest(range(5))::INT AS node FROM r)"


@R.add("c06_snapshot", f"WITH RECURSIVE {SQL_STATES} SELECT user_id, coalesce(string_agg(page * 10 + node, ',' ORDER BY page * 10 + node) FILTER (state = 'Active'), '') AS active, count_if(state = 'Opened')::INT AS n_opened, count_if(state = 'Pruned')::INT AS n_pruned FROM st GROUP BY user_id")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = node_states(spark, sf_dir).withColumn("id", F.col("page") * 10 + F.col("node"))
    return op.snapshot(states, "user_id", "id").select("user_id", F.array_join(F.transform("active", lambda x: x.cast("string")), ",").alias("active"), "n_opened", "n_pruned")


#: Elements with the states of one question each document, and the structural edges between them.
SQL_STATED = f"""{SQL_LAYOUT}, {SQL_SECTIONS}, reading AS (SELECT doc_key, id AS source, lead(id) OVER (PARTITION BY doc_key ORDER BY page_index, element_index) AS target FROM nodes),
e AS (SELECT source || '>' || target || ':' || relation AS edge, * FROM (SELECT source, target, 'layout' AS type, relation FROM layout UNION ALL SELECT source, target, 'section_hierarchy', relation FROM sections
  UNION ALL SELECT source, target, 'reading_order', 'next' FROM reading WHERE target IS NOT NULL)),
n AS (SELECT doc_key, page_index, block_index, id, type, tag, doc_key || ':page:' || page_index AS page_id, page_index < 4 AS allowed, ['Inactive', 'Active', 'Opened', 'Pruned'][block_index % 4 + 1] AS state,
  ['Active', 'Active', 'Inactive', 'Pruned', 'Active'][page_index + 1] AS page_state, page_index % 2 = 0 AS late,
  CASE WHEN type IN ('title', 'table', 'figure', 'image', 'chart') THEN 8 WHEN type IN ('paragraph', 'text', 'list') THEN 3 ELSE 0 END + least(10, len(list_filter(['that', 'with', 'from', 'the'], lambda t: length(t) >= 4 AND contains(lower(tag), t)))) AS relevance FROM nodes),
walk AS (SELECT source AS from_node, target AS node, edge, type AS kind, relation, false AS back FROM e UNION ALL SELECT target, source, edge, type, relation, true FROM e WHERE type IN ('reading_order', 'section_hierarchy') OR relation IN ('left_of', 'right_of'))"""
TERMS = ("that", "with", "from", "the", "that")


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    relevance = bl.relevance(F.col("type"), F.lower("tag"), F.array(*map(F.lit, TERMS)))
    return nodes(spark, sf_dir).select(
        "doc_key", "page_index", "block_index", "id", "type", "tag", F.concat_ws(":", "doc_key", F.lit("page"), "page_index").alias("page_id"), (F.col("page_index") < 4).alias("allowed"),
        pick((op.INACTIVE, op.ACTIVE, op.OPENED, op.PRUNED), F.col("block_index") % 4).alias("state"),
        pick((op.ACTIVE, op.ACTIVE, op.INACTIVE, op.PRUNED, op.ACTIVE), F.col("page_index")).alias("page_state"), (F.col("page_index") % 2 == 0).alias("late"), relevance.alias("relevance"),
    )


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    part = lambda rows, kind: rows.select("source", "target", F.lit(kind).alias("type"), "relation")
    found = part(gr.layout(n, 2), "layout").unionByName(part(gr.sections(n), "section_hierarchy")).unionByName(part(gr.reading_order(n, ["page_index", "element_index"]), "reading_order"))
    return found.withColumn("edge", F.concat("source", F.lit(">"), "target", F.lit(":"), "relation"))


SQL_CANDIDATES = f"""{SQL_STATED}, c AS (SELECT 'page' AS kind, id AS node, page_id AS from_node, '' AS edge, 'containment' AS relation, '' AS hint FROM n WHERE page_state = 'Active' AND state IN ('Inactive', 'Pruned')
UNION SELECT 'edge', w.node, w.from_node, w.edge, w.relation, CASE w.kind WHEN 'reading_order' THEN CASE WHEN back THEN 'previous' ELSE 'next' END WHEN 'section_hierarchy' THEN CASE WHEN back THEN 'parent_section' ELSE 'child_or_section_content' END
  ELSE CASE WHEN back THEN 'spatial_neighbor_reverse' ELSE 'spatial_neighbor' END END FROM walk w JOIN n s ON s.id = w.from_node AND s.state = 'Active' JOIN n t ON t.id = w.node AND t.allowed AND t.page_state <> 'Pruned' AND t.state NOT IN ('Active', 'Opened'))"""


@R.add("c07_c08_candidates", f"WITH {SQL_CANDIDATES} SELECT * FROM c")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread elements of active pages, and what the edges of active elements lead to, with hints."""
    return op.candidates(stated(spark, sf_dir), structure(spark, sf_dir))


#: The order of node types within a page; 9 for others.
SQL_TYPE_RANK = "CASE type WHEN 'table' THEN 0 WHEN 'chart' THEN 1 WHEN 'figure' THEN 2 WHEN 'image' THEN 3 WHEN 'title' THEN 4 WHEN 'paragraph' THEN 5 WHEN 'text' THEN 5 ELSE 9 END"
SQL_PICKS = f"""picks AS (SELECT *, row_number() OVER (PARTITION BY doc_key, page_index ORDER BY relevance DESC, trank, id) AS place FROM (
  SELECT *, {SQL_TYPE_RANK} AS trank, relevance > 0 OR {SQL_TYPE_RANK} <= 4 AS strong, bool_or(relevance > 0 OR {SQL_TYPE_RANK} <= 4) OVER (PARTITION BY doc_key, page_index) AS any_strong FROM n) WHERE strong OR NOT any_strong)"""


@R.add("r22_r23_node_relevance", f"WITH {SQL_STATED}, {SQL_PICKS} SELECT doc_key, page_index, id, relevance::INT AS relevance, place::INT AS place FROM picks WHERE place <= 5")
def node_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best elements of each page for a question."""
    return op.page_picks(stated(spark, sf_dir), ["doc_key", "page_index"], 5).select("doc_key", "page_index", "id", "relevance", "place")


@R.add(
    "c10_neighbour_expansion",
    f"""WITH {SQL_STATED}, {SQL_PICKS}, opened AS (SELECT doc_key, id FROM picks WHERE place <= 3 AND page_index = 0), used AS (SELECT doc_key, greatest(0, 8 - count(*)) AS rest FROM opened GROUP BY doc_key),
m AS (SELECT t.doc_key, w.node, t.relevance, arg_min(w.kind, w.from_node || CASE WHEN back THEN '~1' ELSE '~0' END || w.edge) AS kind FROM walk w JOIN opened o ON o.id = w.from_node JOIN n t ON t.id = w.node WHERE w.node NOT IN (SELECT id FROM opened) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY relevance DESC, kind, node) AS place FROM m) SELECT doc_key, node, kind, relevance::INT AS relevance, place::INT AS place FROM k JOIN used USING (doc_key) WHERE place <= rest""",
)
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three elements of each document's first page are open; their neighbours fill up to eight."""
    n = stated(spark, sf_dir)
    opened = op.page_picks(n.where("page_index = 0"), ["doc_key", "page_index"], 3).select("doc_key", "id")
    return op.neighbour_expansion(opened, n, structure(spark, sf_dir), 8)


@R.add(
    "c11_pages_with_nodes",
    f"""WITH {SQL_PAGES}, sims AS (SELECT q.page_id AS query_id, q.tok AS qt, p.page_id, max(list_dot_product(q.v, p.v)) AS best FROM pages4 q, pages4 p WHERE q.page_id % 50 = 0 GROUP BY ALL),
top AS (SELECT * FROM (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, page_id) AS rank FROM (SELECT query_id, page_id, sum(best) AS total FROM sims GROUP BY ALL)) WHERE rank <= 3),
{SQL_STATED}, {SQL_PICKS} SELECT query_id, rank::INT AS rank, top.page_id, id, place::INT AS place FROM top LEFT JOIN picks ON doc_key = 'd' || (top.page_id // 5) AND page_index = top.page_id % 5 AND place <= 2""",
)
def pages_with_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best pages of each question, and the two best elements of each; pages without elements stay."""
    vectors = page_vectors(spark, sf_dir)
    top = retrieval.vector_top_k(asked(vectors), vectors, 3).select("query_id", "rank", "page_id")
    picks = op.page_picks(stated(spark, sf_dir), ["doc_key", "page_index"], 2).select("doc_key", "page_index", "id", "place")
    key = (F.concat(F.lit("d"), F.floor(F.col("page_id") / 5).cast("string")) == F.col("doc_key")) & (F.col("page_id") % 5 == F.col("page_index"))
    return top.join(picks, key, "left").select("query_id", "rank", "page_id", "id", "place")


@R.add(
    "c12_final_opens",
    f"""WITH RECURSIVE {SQL_STATED}, {SQL_PICKS}, f1 AS (SELECT * FROM (SELECT doc_key, id, row_number() OVER (PARTITION BY doc_key ORDER BY relevance DESC, id) AS r FROM n WHERE state = 'Active') WHERE r <= 9),
pg AS (SELECT doc_key, page_index, list(picks.state NOT IN ('Opened') AND picks.id NOT IN (SELECT id FROM f1) ORDER BY place) AS fresh, row_number() OVER (PARTITION BY doc_key ORDER BY page_index) AS k FROM picks WHERE page_state = 'Active' AND late GROUP BY doc_key, page_index),
w AS (SELECT doc_key, 0::BIGINT AS k, (9 - count(id))::BIGINT AS rest, NULL::INT AS page_index, 0::BIGINT AS had FROM (SELECT DISTINCT doc_key FROM n) d LEFT JOIN f1 USING (doc_key) GROUP BY doc_key
  UNION ALL SELECT w.doc_key, pg.k, w.rest - len(list_filter(pg.fresh[1:w.rest], lambda x: x)), pg.page_index, w.rest FROM w JOIN pg ON pg.doc_key = w.doc_key AND pg.k = w.k + 1)
SELECT doc_key, id, 'node' AS step FROM f1 UNION ALL SELECT p.doc_key, p.id, 'page' FROM picks p JOIN w ON w.doc_key = p.doc_key AND w.page_index = p.page_index WHERE place <= had AND state <> 'Opened' AND id NOT IN (SELECT id FROM f1)""",
)
def final_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.final_opens(stated(spark, sf_dir), "doc_key", 9)


@R.add(
    "c13_decisions",
    """SELECT conv_id, turn, turn % 2 = 0 AS stop, CASE WHEN turn % 3 = 0 THEN '' ELSE turn || ',' || (turn + 1) END AS selected, CASE WHEN turn % 3 = 0 THEN '' ELSE role || ',' END AS utilities, 'n' || turn AS opened,
CASE WHEN turn % 4 = 1 THEN '' ELSE 'p' || turn || '=a & b' END AS pruned, 'find <' || role || '>' AS query FROM conversations""",
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with words around them, parts missing and attributes quoted either way."""
    turn = F.col("turn").cast("string")
    chosen = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit('<selected_actions><action utility="'), "role", F.lit('" index="'), turn, F.lit("\"/><action candidate_index='"), (F.col("turn") + 1).cast("string"), F.lit("'></action></selected_actions>")))
    pruned = F.when(F.col("turn") % 4 == 1, "").otherwise(F.concat(F.lit('<prune_requests><page id="p'), turn, F.lit('"><reason>a &amp; b</reason></page></prune_requests>')))
    text = F.concat(F.lit("Sure, here it is.\n<agent_decision><stop>"), F.when(F.col("turn") % 2 == 0, "True").otherwise("no"), F.lit("</stop>\n"), chosen, F.lit('<open_requests>\n<node id="n'), turn, F.lit('"/></open_requests>'), pruned, F.lit("<search_request><query> find &lt;"), "role", F.lit("&gt; </query></search_request>"))
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", op.decision(text).alias("d"))
    show = lambda c, f: F.array_join(F.transform(c, f), ",")
    return got.select(
        "conv_id", "turn", "d.stop", show("d.selected", lambda x: x["candidate"].cast("string")).alias("selected"), show("d.selected", lambda x: x["utility"]).alias("utilities"), F.array_join("d.open", ",").alias("opened"),
        show("d.prune", lambda x: F.concat(x["node"], F.lit("="), x["reason"])).alias("pruned"), "d.query",
    )


SQL_ESC = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@R.add(
    "c14_evaluator_context",
    f"""WITH {SQL_CANDIDATES}, l AS (SELECT doc_key, page_index, page_id, string_agg('<node id="' || id || '" type="' || type || '" state="' || lower(state) || '">' || {SQL_ESC('tag')} || '</node>', chr(10) ORDER BY block_index) AS body FROM n WHERE page_state <> 'Pruned' AND state IN ('Active', 'Opened') GROUP BY ALL),
x AS (SELECT doc_key, string_agg('<page id="' || page_id || '" index="' || page_index || '">' || chr(10) || body || chr(10) || '</page>', chr(10) ORDER BY page_index) AS xml FROM l GROUP BY doc_key),
k AS (SELECT string_split(node, ':')[1] AS doc_key, *, row_number() OVER (PARTITION BY string_split(node, ':')[1] ORDER BY node, from_node, edge) AS i FROM c),
y AS (SELECT doc_key, string_agg('<action index="' || i || '" node="' || node || '" relation="' || relation || '"/>', chr(10) ORDER BY i) AS xml FROM k GROUP BY doc_key)
SELECT doc_key, md5(x.xml) AS evidence_md5, md5(y.xml) AS actions_md5 FROM x FULL JOIN y USING (doc_key)""",
)
def evaluator_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by page, and numbered candidates, as the markup an evaluator is shown."""
    n = stated(spark, sf_dir)
    shown = op.evidence_xml(n.withColumnRenamed("tag", "text"), "doc_key").select("doc_key", F.md5("xml").alias("evidence_md5"))
    found = op.candidates(n, structure(spark, sf_dir)).withColumn("doc_key", F.substring_index("node", ":", 1))
    return shown.join(op.numbered_actions(found, "doc_key").select("doc_key", F.md5("xml").alias("actions_md5")), "doc_key", "full")


@R.add(
    "c15_recent_trace",
    """WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, md5(string_agg('<event action="' || event_type || '" target="' || event_id || '"/>', chr(10) ORDER BY back DESC)) AS xml_md5 FROM t WHERE back <= 25 GROUP BY user_id""",
)
def recent_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.concat(F.lit('action="'), "event_type", F.lit('" target="'), F.col("event_id").cast("string"), F.lit('"'))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", attrs.alias("attrs"))
    return op.recent_trace(events, "user_id", ["ts", "event_id"]).select("user_id", F.md5("xml").alias("xml_md5"))


@R.add(
    "c16_reader_pages",
    """WITH a AS (SELECT user_id, (event_id % 7)::INT AS page_index, ts, event_id, CASE event_type WHEN 'purchase' THEN 'question_page_scope' ELSE event_type END AS source FROM events WHERE event_id % 7 <> 6),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, page_index ORDER BY ts, event_id) AS k FROM a),
p AS (SELECT user_id, page_index, row_number() OVER (PARTITION BY user_id ORDER BY CASE source WHEN 'question_page_scope' THEN 0 ELSE 1 END, ts, event_id) AS place FROM f WHERE k = 1)
SELECT user_id, string_agg(page_index, ',' ORDER BY place) AS pages FROM p GROUP BY user_id""",
)
def reader_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a reader gets the pages that aren't pruned."""
    page, kind = (F.col("event_id") % 7).cast("int"), F.col("event_type")
    acts = table(spark, sf_dir, "events").select("user_id", page.alias("page_index"), F.struct("ts", "event_id").alias("step"), F.when(kind == "purchase", "question_page_scope").otherwise(kind).alias("source"), (page == 6).alias("pruned"))
    ranked = op.reader_pages(acts, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "page_index"))).alias("p"))
    return ranked.select("user_id", F.array_join(F.transform("p", lambda x: x["page_index"].cast("string")), ",").alias("pages"))


#: States as ranks; the strongest of a page's nodes is the page's.
SQL_STATE_RANK = "CASE state WHEN 'Pruned' THEN 3 WHEN 'Opened' THEN 2 WHEN 'Active' THEN 1 ELSE 0 END"
RANKS = {op.INACTIVE: 0, op.ACTIVE: 1, op.OPENED: 2, op.PRUNED: 3}


@R.add(
    "m23_page_board",
    f"""WITH RECURSIVE {SQL_STATES}, g AS (SELECT user_id, page, count_if(state = 'Active') AS n_active, count_if(state = 'Opened') AS n_opened, count_if(state = 'Pruned') AS n_pruned, ['Inactive', 'Active', 'Opened', 'Pruned'][max({SQL_STATE_RANK}) + 1] AS dominant FROM st GROUP BY ALL),
p AS (SELECT DISTINCT user_id, unnest(range(user_id % 3 + 1))::INT AS page FROM events UNION SELECT user_id, page FROM g), k AS (SELECT user_id, page, count(*) AS n_actions FROM a GROUP BY ALL),
ev AS (SELECT DISTINCT user_id, unnest([user_id % 4, user_id % 4 - 1])::INT AS page FROM events)
SELECT p.user_id, p.page, coalesce(n_active, 0) AS n_active, coalesce(n_opened, 0) AS n_opened, coalesce(n_pruned, 0) AS n_pruned, coalesce(dominant, 'Inactive') AS dominant, coalesce(n_actions, 0) AS n_actions, ev.page IS NOT NULL AS is_evidence
FROM p LEFT JOIN g USING (user_id, page) LEFT JOIN k USING (user_id, page) LEFT JOIN ev ON ev.user_id = p.user_id AND ev.page = p.page""",
)
def page_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a question, allowed or touched: states of their nodes, the strongest of these, actions, evidence."""
    acts = trace(spark, sf_dir)
    users = acts.select("user_id").distinct()
    allowed = users.select("user_id", F.explode(F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int"))).alias("page"))
    gold = users.select("user_id", F.explode(F.array((F.col("user_id") % 4).cast("int"), (F.col("user_id") % 4 - 1).cast("int"))).alias("page")).distinct()
    return op.page_board(allowed, node_states(spark, sf_dir), acts, gold, "user_id")


@R.add(
    "m24_node_board",
    f"""WITH RECURSIVE {SQL_STATES}, k AS (SELECT user_id, page, node, count(*) AS n FROM a GROUP BY ALL)
SELECT user_id, page, node, state, coalesce(n, 0) AS n_actions FROM st LEFT JOIN k USING (user_id, page, node) WHERE node > 0""",
)
def node_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and number of actions of each element."""
    counts = trace(spark, sf_dir).groupBy("user_id", "page", "node").agg(F.count("*").alias("n"))
    return node_states(spark, sf_dir).where("node > 0").join(counts, ["user_id", "page", "node"], "left").select("user_id", "page", "node", "state", F.coalesce("n", F.lit(0)).alias("n_actions"))


@R.add(
    "m22_trace_table",
    """WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER w - 1 AS step, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, step::INT AS step, event_type, (event_id % 3)::INT AS page, coalesce(before, '') AS before, before IS NULL OR before <> event_type AS changed FROM t""",
)
def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each trace with their page and whether the state changed."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumns({"step": F.row_number().over(w) - 1, "b": F.lag("event_type").over(w)})
    return rows.select("user_id", "event_id", "step", "event_type", (F.col("event_id") % 3).cast("int").alias("page"), F.coalesce("b", F.lit("")).alias("before"), (F.col("b").isNull() | (F.col("b") != F.col("event_type"))).alias("changed"))


@R.add(
    "m25_expansion_deltas",
    """WITH s AS (SELECT user_id, event_id, list(DISTINCT event_id % 9) OVER w AS b, list(DISTINCT event_id % 9) OVER v AS a FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(a, x))), ',') AS removed, len(a)::INT AS n_after FROM s""",
)
def expansion_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a step adds to and takes from the nodes in view, here those of the last four steps."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.col("event_id") % 9
    sets = table(spark, sf_dir, "events").withColumns({"before": F.collect_set(node).over(w.rowsBetween(-4, -1)), "after": F.collect_set(node).over(w.rowsBetween(-3, 0))})
    return op.set_deltas(sets, "before", "after").select("user_id", "event_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), F.size("after").alias("n_after"))


@R.add(
    "m25_j17_graph_snapshots",
    f"""WITH {SQL_STATED}, vis AS (SELECT id, page_index AS iteration FROM n WHERE state <> 'Inactive') SELECT s.iteration, e.edge, e.type FROM e JOIN vis s ON s.id = e.source JOIN vis t ON t.id = e.target AND t.iteration = s.iteration""",
)
def graph_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends among the nodes that an iteration (here a page's) shows."""
    seen = stated(spark, sf_dir).where(F.col("state") != op.INACTIVE).select(F.col("page_index").alias("iteration"), "id")
    return op.visible_edges(seen, structure(spark, sf_dir), "iteration").select("iteration", "edge", "type")


@R.add(
    "c16_reader_layout",
    """WITH p AS (SELECT user_id, (event_id % 7)::INT AS page_index, min(event_id) FILTER (event_type = 'view') AS step, arg_min(CASE WHEN event_id % 3 = 0 THEN 'question_page_scope' ELSE 'search' END, event_id) FILTER (event_type = 'view') AS source
  FROM events WHERE event_id % 7 <> 6 GROUP BY ALL),
n AS (SELECT user_id, (event_id % 35)::INT AS id, (event_id % 7)::INT AS page_index, arg_max(CASE event_type WHEN 'click' THEN 'Opened' WHEN 'view' THEN 'Active' WHEN 'purchase' THEN 'Pruned' ELSE 'Inactive' END, event_id) AS state FROM events WHERE event_id % 7 <> 6 GROUP BY ALL),
h AS (SELECT * FROM n WHERE state IN ('Active', 'Opened')),
l AS (SELECT user_id, page_index, min(CASE state WHEN 'Active' THEN id ELSE 100 + id END) AS least FROM h GROUP BY ALL),
o AS (SELECT user_id, page_index, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN step IS NULL THEN 2 WHEN source = 'question_page_scope' THEN 0 ELSE 1 END, step, least, page_index) AS place FROM p LEFT JOIN l USING (user_id, page_index) WHERE step IS NOT NULL OR least IS NOT NULL),
x AS (SELECT user_id, place, 0 AS position, page_index, NULL::INT AS id, CASE WHEN page_index % 2 = 0 THEN 'page' END AS kind FROM o
  UNION ALL SELECT user_id, place, row_number() OVER (PARTITION BY user_id, page_index ORDER BY state <> 'Opened', id), page_index, id, CASE WHEN id % 3 = 0 THEN 'opened_node_image' WHEN id % 5 = 0 AND page_index % 2 = 0 THEN 'opened_node_crop' END FROM h JOIN o USING (user_id, page_index)),
y AS (SELECT *, count(kind) OVER (PARTITION BY user_id ORDER BY place, position) AS n FROM x)
SELECT user_id, place::INT AS place, position::INT AS position, page_index, id, kind, CASE kind WHEN 'page' THEN 'page_image_' || n ELSE 'node_image_' || n END || left(kind, 0) AS ref, CASE WHEN kind IS NOT NULL THEN n - 1 END::INT AS image_index FROM y""",
)
def reader_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as questions: pages by their first view, nodes in the state of their last event, images of some."""
    at, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").where(at % 7 != 6).select("user_id", at, kind, (at % 7).cast("int").alias("page_index"), (at % 35).cast("int").alias("id"))
    seen = F.when(kind == "view", F.struct(at, F.when(at % 3 == 0, "question_page_scope").otherwise("search").alias("source")))
    pages = rows.groupBy("user_id", "page_index").agg(F.min(seen).alias("s")).select("user_id", "page_index", F.lit(False).alias("pruned"), F.col("s.event_id").alias("step"), "s.source", (F.col("page_index") % 2 == 0).alias("has_image"))
    state = F.when(kind == "click", "Opened").when(kind == "view", "Active").when(kind == "purchase", "Pruned").otherwise("Inactive")
    nodes = rows.groupBy("user_id", "page_index", "id").agg(F.max_by(state, at).alias("state")).withColumns({"has_image": F.col("id") % 3 == 0, "can_crop": F.col("id") % 5 == 0})
    return shown.reader_layout(pages, nodes, "user_id")


@R.add(
    "c15_trace_steps",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, event_id % 4 AS k, event_id % 9 AS pg FROM events),
l AS (SELECT user_id, back, '    <step iteration="' || event_id % 5 || '" action="' || CASE event_type WHEN 'view' THEN 'ActivatePage' WHEN 'click' THEN 'OpenNode' WHEN 'purchase' THEN 'PruneNode' WHEN 'signup' THEN 'EvaluatorDecision' ELSE 'InvalidCandidate' END
  || '" ok="' || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END || '"' || CASE event_type
  WHEN 'view' THEN ' page_index="' || pg || '" page_node="page:' || pg || '" source="view" previous_state="Inactive"/>'
  WHEN 'click' THEN ' target="n' || event_id || '" selection="' || k || '" candidate="c&lt;' || k || '"/>'
  WHEN 'purchase' THEN ' target="n' || event_id || '">' || chr(10) || '      <reason>r&amp;' || event_id || '</reason>' || chr(10) || '    </step>'
  WHEN 'signup' THEN ' stop="' || CASE WHEN event_id % 3 = 0 THEN 'True' ELSE 'False' END || '" selected_actions="2" open_requests="0" prune_requests="0"' || CASE WHEN k = 1 THEN ' query="find ' || event_id || '"' ELSE '' END || '>' || chr(10)
    || '      <selected_actions>' || chr(10) || '        <action index="' || k || '" candidate="cand" utility="high"/>' || chr(10) || '        <action index="99"/>' || chr(10) || '      </selected_actions>'
    || CASE WHEN k = 1 THEN chr(10) || '      <search_request>find ' || event_id || '</search_request>' ELSE '' END || chr(10) || '    </step>'
  ELSE ' candidate_index="' || k || '">' || chr(10) || '      <message>bad &quot;' || event_id || '&quot;</message>' || chr(10) || '    </step>' END AS line FROM t WHERE back <= 25)
SELECT user_id, md5('  <recent_trace>' || chr(10) || string_agg(line, chr(10) ORDER BY back DESC) || chr(10) || '  </recent_trace>') AS xml_md5 FROM l GROUP BY user_id""",
)
def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recorded steps of five kinds, each with its attributes and body."""
    at, kind, k = F.col("event_id"), F.col("event_type"), (F.col("event_id") % 4).cast("int")
    name = lambda prefix: F.concat(F.lit(prefix), at.cast("string"))
    action = F.when(kind == "view", "ActivatePage").when(kind == "click", "OpenNode").when(kind == "purchase", "PruneNode").when(kind == "signup", "EvaluatorDecision").otherwise("InvalidCandidate")
    payload = F.struct(
        F.when(kind == "view", (at % 9).cast("int")).alias("page_index"), F.when(kind == "view", kind).alias("source"), F.when(kind == "view", "Inactive").alias("previous_state"),
        F.when(kind.isin("click", "purchase"), name("n")).alias("node_id"), F.when(kind == "purchase", name("r&")).alias("reason"),
    )
    selection = F.when(kind == "click", F.struct(k.alias("candidate_index"), F.concat(F.lit("c<"), k.cast("string")).alias("candidate_id")))
    picks = F.array(F.struct(k.alias("candidate_index"), F.lit("high").alias("utility")), F.struct(F.lit(99).alias("candidate_index"), F.lit(None).cast("string").alias("utility")))
    decision = F.when(kind == "signup", F.struct((at % 3 == 0).alias("stop"), picks.alias("selected_actions"), F.when(k == 1, name("find ")).alias("search_query")))
    item = F.struct(
        (at % 5).cast("int").alias("iteration"), action.alias("action"), (at % 2 == 0).alias("ok"), payload.alias("payload"), selection.alias("selection"), decision.alias("decision"), F.create_map(k.cast("string"), F.lit("cand")).alias("candidate_index_map"),
        F.when(kind == "error", k).alias("candidate_index"), F.when(kind == "error", F.concat(name('bad "'), F.lit('"'))).alias("message"),
    )
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.to_json(item).alias("item"))
    page_node = lambda i: F.concat(F.lit("page:"), i.cast("string"))
    return shown.recent_steps(rows, "user_id", ["ts", "event_id"], "item", page_node).select("user_id", F.md5("xml").alias("xml_md5"))


@R.add(
    "c13_decisions_in_texts",
    r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || chr(10) || '```xml' || chr(10) || '<Agent_Decision>' || CASE WHEN turn % 3 = 0 THEN '<STOP>' || chr(10) || 'Yes </STOP>' WHEN turn % 3 = 1 THEN '<stop>no</stop>' ELSE '<stop>true' END
  || '<candidate_actions><action index="77"/></candidate_actions>' || CASE WHEN turn % 2 = 0 THEN '<selected_actions>' ELSE '' END || '<action utility="' || role || '" index="' || turn || '"/><ACTION candidate_index="' || (turn + 1) || '">' || CASE WHEN turn % 4 = 0 THEN '</selected_actions><action index="88"/>' ELSE '' END
  || '<search_request><query>' || left(coalesce(text, ''), 60) || '</query>' || CASE WHEN turn % 5 = 0 THEN '' ELSE '<prune_requests><node id="n' || turn || '"><reason>' || right(coalesce(text, ''), 30) || '</reason></node></prune_requests>' END AS x FROM conversations),
u AS (SELECT *, lower(x) AS l, CASE WHEN turn % 4 = 0 THEN regexp_extract(x, '(?s)<selected_actions>(.*)</selected_actions>', 1) ELSE regexp_replace(x, '(?s)<candidate_actions>.*</candidate_actions>', '') END AS region FROM t)
SELECT conv_id, turn, position('<stop>' IN l) > 0 AND position('</stop>' IN l) > 0 AND trim(split_part(split_part(l, '<stop>', 2), '</stop>', 1), chr(10) || ' ') IN ('yes', 'true', '1') AS stop,
  array_to_string(list_transform(regexp_extract_all(region, '(?i)<action[^>]*>'), lambda a: regexp_extract(a, 'index="([0-9]+)', 1)), ',') AS selected,
  trim(regexp_replace(split_part(split_part(x, '<query>', 2), '</query>', 1), '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS query,
  CASE WHEN position('<reason>' IN x) = 0 THEN '' ELSE trim(regexp_replace(split_part(split_part(x, '<reason>', 2), '</reason>', 1), '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) END AS reason FROM u""",
)
def decisions_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken decisions among the words of conversations: tags in any case, left open, without their block, beside offered candidates."""
    turn, said = F.col("turn"), F.coalesce("text", F.lit(""))
    stop = F.when(turn % 3 == 0, "<STOP>\nYes </STOP>").when(turn % 3 == 1, "<stop>no</stop>").otherwise("<stop>true")
    actions = F.concat(
        F.when(turn % 2 == 0, "<selected_actions>").otherwise(""), F.lit('<action utility="'), "role", F.lit('" index="'), turn.cast("string"), F.lit('"/><ACTION candidate_index="'), (turn + 1).cast("string"), F.lit('">'),
        F.when(turn % 4 == 0, '</selected_actions><action index="88"/>').otherwise(""),
    )
    prune = F.when(turn % 5 == 0, "").otherwise(F.concat(F.lit('<prune_requests><node id="n'), turn.cast("string"), F.lit('"><reason>'), F.right(said, F.lit(30)), F.lit("</reason></node></prune_requests>")))
    text = F.concat(said, F.lit("\n```xml\n<Agent_Decision>"), stop, F.lit('<candidate_actions><action index="77"/></candidate_actions>'), actions, F.lit("<search_request><query>"), F.left(said, F.lit(60)), F.lit("</query>"), prune)
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", op.decision(text).alias("d"))
    numbers = F.array_join(F.transform("d.selected", lambda x: x["candidate"].cast("string")), ",")
    return got.select("conv_id", "turn", "d.stop", numbers.alias("selected"), "d.query", F.coalesce(F.get("d.prune", F.lit(0))["reason"], F.lit("")).alias("reason"))
