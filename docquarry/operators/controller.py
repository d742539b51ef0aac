"""The exploration state machine: replayed actions, candidates, deterministic expansion, what reader and evaluator see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import escape_xml
from docquarry.sources.scratch import keep

INACTIVE, ACTIVE, OPENED, PRUNED = "Inactive", "Active", "Opened", "Pruned"
#: Edge types and layout relations that are followed against their direction too.
BOTH_WAYS, BOTH_WAYS_LAYOUT = ("reading_order", "section_hierarchy"), ("left_of", "right_of")


def replay(actions: DataFrame, by: list[str], order: list[str], n_nodes: int) -> DataFrame:
    """``(*by, states, n_actions, n_refused)`` of each (question, page) after its recorded actions in order.

    ``actions`` has node (0 the page itself, 1 to ``n_nodes`` - 1 its elements), action and allowed (whether the page is in
    the mask). Activating takes an allowed page, for an element one that isn't pruned, and activates an inactive page
    with its element; from any state the target becomes Active. Opening takes an active element of a page that isn't
    pruned. Pruning takes anything not pruned yet. What isn't taken changes nothing and counts as refused.

    The state of a page depends on its own actions only, so a group is a page's trace, which a run's action limit bounds.
    """
    said = F.array_sort(F.collect_list(F.struct(*order, "node", "action", "allowed")))
    start = F.struct(F.array_repeat(F.lit(INACTIVE), n_nodes).alias("states"), F.lit(0).alias("refused"))

    def fold(acc: Column, x: Column) -> Column:
        own, page, element = F.get(acc["states"], x["node"]), F.get(acc["states"], F.lit(0)), x["node"] > 0
        live = page != PRUNED
        taken = (
            F.when(x["action"] == "activate", x["allowed"] & (~element | live))
            .when(x["action"] == "open", element & (own == ACTIVE) & live)
            .when(x["action"] == "prune", own != PRUNED)
            .otherwise(F.lit(False))
        )
        new = F.when(x["action"] == "activate", ACTIVE).when(x["action"] == "open", OPENED).otherwise(PRUNED)
        with_page = (x["action"] == "activate") & element

        def after(s: Column, i: Column) -> Column:
            return F.when(taken & (i == x["node"]), new).when(taken & with_page & (i == 0) & (s == INACTIVE), ACTIVE).otherwise(s)

        known = x["action"].isin("activate", "open", "prune")
        return F.struct(F.transform(acc["states"], after).alias("states"), (acc["refused"] + (known & ~taken).cast("int")).alias("refused"))

    held = actions.groupBy(*by).agg(said.alias("said"))
    return held.select(*by, F.aggregate("said", start, fold).alias("end"), F.size("said").alias("n_actions")).select(*by, "end.states", "n_actions", F.col("end.refused").alias("n_refused"))


def snapshot(states: DataFrame, question: str, node: str) -> DataFrame:
    """Per question the sorted ids of each state and their numbers."""
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col(node))))
    return states.groupBy(question).agg(ids(ACTIVE).alias("active"), ids(OPENED).alias("opened"), ids(PRUNED).alias("pruned")).withColumns(
        {f"n_{c}": F.size(c) for c in ("active", "opened", "pruned")}
    )


def both_ways(kind: Column, relation: Column) -> Column:
    return kind.isin(*BOTH_WAYS) | ((kind == "layout") & relation.isin(*BOTH_WAYS_LAYOUT))


#: What the evaluator is told of an edge, by its type: along it, and against it.
HINTS = {"reading_order": ("next", "previous"), "section_hierarchy": ("child_or_section_content", "parent_section"), "layout": ("spatial_neighbor", "spatial_neighbor_reverse"), "containment": ("page_contains_element", "page_contains_element")}


def traversal_hint(kind: Column, relation: Column, reverse: Column) -> Column:
    told = F.create_map(*[F.lit(x) for k, (along, against) in HINTS.items() for x in (k, along, f"{k} back", against)])
    known = (kind != "layout") | relation.isin(*BOTH_WAYS_LAYOUT)
    return F.coalesce(F.when(known, F.try_element_at(told, F.when(reverse, F.concat(kind, F.lit(" back"))).otherwise(kind))), F.lit("stored_direction"))


def followed(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, from_node, edge, kind, relation, back)`` one step from each ``frontier(from_node)``, against an edge where that is allowed.

    ``edges(edge, source, target, type, relation)``.
    """
    shape = lambda s, t, back: edges.select(F.col(s).alias("s"), F.col(t).alias("node"), "edge", F.col("type").alias("kind"), "relation", F.lit(back).alias("back"))
    steps = shape("source", "target", False).unionByName(shape("target", "source", True).where(both_ways(F.col("kind"), F.col("relation"))))
    return frontier.join(steps, F.col("from_node") == F.col("s")).drop("s")


def candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, node, from_node, edge, relation, hint)``: what may be activated next, each once.

    ``nodes(id, page_id, state, page_state, allowed)`` are elements with the states of a question; unread ones of active pages
    come by containment, others along the edges of active elements unless they are active or opened already, their
    page is pruned or outside the mask.
    """
    unread = nodes.where((F.col("page_state") == ACTIVE) & F.col("state").isin(INACTIVE, PRUNED))
    unread = unread.select(F.lit("page").alias("kind"), F.col("id").alias("node"), F.col("page_id").alias("from_node"), F.lit("").alias("edge"), F.lit("containment").alias("relation"), F.lit("").alias("hint"))
    steps = followed(nodes.where(F.col("state") == ACTIVE).select(F.col("id").alias("from_node")), edges)
    goal = nodes.where(F.col("allowed") & (F.col("page_state") != PRUNED) & ~F.col("state").isin(ACTIVE, OPENED)).select(F.col("id").alias("goal"))
    met = steps.join(goal, F.col("node") == F.col("goal"))
    met = met.select(F.lit("edge").alias("kind"), "node", "from_node", "edge", "relation", traversal_hint(F.col("kind"), F.col("relation"), F.col("back")).alias("hint"))
    return unread.unionByName(met).distinct()


def neighbour_expansion(opened: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """``(doc_key, node, kind, relevance, place)``: with what is left of ``limit`` after the opened nodes of a document, its
    neighbours by relevance, edge type and id; a neighbour counts once, by its first edge."""
    steps = followed(opened.select(F.col("id").alias("from_node")), edges)
    fresh = nodes.join(opened.select(F.col("id").alias("done")), F.col("id") == F.col("done"), "left_anti").select("doc_key", "id", "relevance")
    met = steps.join(fresh, F.col("node") == F.col("id")).groupBy("doc_key", "node", "relevance").agg(F.min_by("kind", F.struct("from_node", "back", "edge")).alias("kind"))
    left = opened.groupBy(F.col("doc_key").alias("of")).agg(F.greatest(F.lit(0), limit - F.count("*")).alias("left"))
    order = Window.partitionBy("doc_key").orderBy(F.col("relevance").desc(), "kind", "node")
    ranked = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return ranked.join(left, F.col("doc_key") == F.col("of")).where(F.col("place") <= F.col("left")).select("doc_key", "node", "kind", "relevance", "place")


def page_picks(nodes: DataFrame, by: list[str], n: int) -> DataFrame:
    """``nodes`` with place: the first ``n`` of each page by relevance, type and id; nodes without relevance or a strong type only
    where a page has no others. ``nodes(*by, id, type, relevance)``."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_ORDER.items() for x in kv]), F.col("type")), F.lit(9))
    strong = (F.col("relevance") > 0) | (rank <= 4)
    order = Window.partitionBy(*by).orderBy((~strong).cast("int"), F.col("relevance").desc(), rank, "id")
    # strong nodes come first, so a page has others only if its first is one
    placed = nodes.withColumns({"strong": strong, "place": F.row_number().over(order)}).where(F.col("place") <= n)
    firm = placed.withColumn("firm", F.max("strong").over(Window.partitionBy(*by)))
    return firm.where("strong or not firm").drop("strong", "firm")


#: Order of node types within a page.
TYPE_ORDER = {"table": 0, "chart": 1, "figure": 2, "image": 3, "title": 4, "paragraph": 5, "text": 5}


def final_opens(nodes: DataFrame, by: str, limit: int) -> DataFrame:
    """``(by, id, step)``: active elements by relevance and id up to ``limit`` ("node"); what is left goes to the picks of active
    pages that were activated by search or an edge, page by page ("page").

    A page offers as many of its picks as are left when its turn comes, opened ones among them counted but not opened again.
    ``nodes(by, page_index, id, type, relevance, state, page_state, late)``.
    """
    rank = Window.partitionBy(by).orderBy(F.col("relevance").desc(), "id")
    first = nodes.where(F.col("state") == ACTIVE).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= limit).select(by, "id")
    picks = page_picks(nodes.where((F.col("page_state") == ACTIVE) & F.col("late")), [by, "page_index"], limit)
    done = first.select(F.col("id").alias("done_id"))
    picks = picks.join(done, F.col("id") == F.col("done_id"), "left").withColumn("fresh", F.col("done_id").isNull() & (F.col("state") != OPENED))
    flags = F.transform(F.array_sort(F.collect_list(F.struct("place", "fresh"))), lambda x: x["fresh"])
    pages = picks.groupBy(by, "page_index").agg(flags.alias("flags"))
    used = first.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("used"))
    turns = pages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page_index", "flags"))).alias("pages")).join(used, F.col(by) == F.col("of"), "left")
    left = (limit - F.coalesce("used", F.lit(0))).cast("int")
    start = F.struct(left.alias("left"), F.array().cast("array<struct<page_index:int,had:int>>").alias("out"))

    def turn(acc: Column, x: Column) -> Column:
        opened = F.size(F.filter(F.slice(x["flags"], F.lit(1), acc["left"]), lambda f: f))
        return F.struct((acc["left"] - opened).alias("left"), F.array_append(acc["out"], F.struct(x["page_index"].cast("int").alias("page_index"), acc["left"].alias("had"))).alias("out"))

    had = turns.select(F.col(by).alias("of"), F.inline(F.aggregate("pages", start, turn)["out"]))
    had = had.withColumnRenamed("page_index", "of_page")
    rest = picks.join(had, (F.col(by) == F.col("of")) & (F.col("page_index") == F.col("of_page"))).where("fresh and place <= had")
    return first.select(by, "id", F.lit("node").alias("step")).unionByName(rest.select(by, "id", F.lit("page").alias("step")))


def reader_pages(activations: DataFrame, by: str) -> DataFrame:
    """``(by, page_index, place)``: pages in the order they were first activated, those named by the question first.

    ``activations(by, page_index, step, source, pruned)``.
    """
    first = activations.where(~F.col("pruned")).groupBy(by, "page_index").agg(F.min(F.struct("step", "source")).alias("first"))
    late = (F.col("first.source") != "question_page_scope").cast("int")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(late, "first.step", "page_index"))).select(by, "page_index", "place")


def _inside(text: Column, block: str) -> Column:
    return F.regexp_extract(text, rf"(?is)<{block}\b[^>]*>(.*?)</{block}>", 1)


def _items(text: Column, item: str) -> Column:
    """Each of these elements with what follows it up to the next one."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<(?:{item})\b[^>]*>(?:(?!<(?:{item})\b).)*"), F.lit(0))


def _elements(text: Column, block: str, item: str) -> Column:
    """The items inside a block."""
    return _items(_inside(text, block), item)


def _attribute(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"""(?is)^<[^>]*?\b{name}\s*=\s*(['"])(.*?)\1""", 2)


def _inner(text: Column, tag: str) -> Column:
    plain = F.regexp_replace(F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.btrim(plain, F.lit(" \t\n\r"))


def decision(text: Column) -> Column:
    """A decision read from XML that may lack closing tags or have words around it: stop, selected candidate numbers and
    their utilities, nodes to open, nodes to prune with reasons, query. Where no block of selected actions is closed and filled, actions
    count wherever they stand but among the candidates."""
    offered = F.regexp_replace(text, r"(?is)<candidate_actions\b[^>]*>.*?</candidate_actions>", "")
    block = _inside(text, "selected_actions")
    chosen = _items(F.when(block != "", block).otherwise(offered), "action")
    number = lambda a: F.coalesce(F.nullif(_attribute(a, "index"), F.lit("")), _attribute(a, "candidate_index")).try_cast("int")
    return F.struct(
        F.lower(_inner(text, "stop")).isin("true", "1", "yes").alias("stop"),
        F.transform(chosen, lambda a: F.struct(number(a).alias("candidate"), _attribute(a, "utility").alias("utility"))).alias("selected"),
        F.transform(_elements(text, "open_requests", "node"), lambda a: _attribute(a, "id")).alias("open"),
        F.transform(_elements(text, "prune_requests", "node|page"), lambda a: F.struct(_attribute(a, "id").alias("node"), _inner(a, "reason").alias("reason"))).alias("prune"),
        _inner(text, "query").alias("query"),
    )


def evidence_xml(nodes: DataFrame, by: str) -> DataFrame:
    """``(by, xml)``: the active and opened elements of each page that isn't pruned, pages and elements in order.

    ``nodes(by, page_index, page_id, page_state, block_index, id, type, state, text)``.
    """
    shown = nodes.where((F.col("page_state") != PRUNED) & F.col("state").isin(ACTIVE, OPENED))
    attrs = F.concat(F.lit('<node id="'), escape_xml(F.col("id"), True), F.lit('" type="'), escape_xml(F.col("type"), True), F.lit('" state="'), F.lower("state"), F.lit('">'))
    line = F.concat(attrs, escape_xml(F.col("text")), F.lit("</node>"))
    gather = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n")
    pages = shown.withColumn("line", line).groupBy(by, "page_index", "page_id").agg(gather("block_index", "line").alias("body"))
    head = F.concat(F.lit('<page id="'), escape_xml(F.col("page_id"), True), F.lit('" index="'), F.col("page_index").cast("string"), F.lit('">\n'))
    return pages.withColumn("page", F.concat(head, "body", F.lit("\n</page>"))).groupBy(by).agg(gather("page_index", "page").alias("xml"))


def numbered_actions(candidates: DataFrame, by: str) -> DataFrame:
    """``(by, xml)``: candidates as numbered actions, in their order."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("node", "from_node", "edge"))
    line = F.concat(F.lit('<action index="'), n.cast("string"), F.lit('" node="'), escape_xml(F.col("node"), True), F.lit('" relation="'), escape_xml(F.col("relation"), True), F.lit('"/>'))
    rows = candidates.select(by, n.alias("n"), line.alias("line"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("xml"))


def recent_trace(events: DataFrame, by: str, order: list[str], limit: int = 25) -> DataFrame:
    """``(by, xml)``: the last ``limit`` events of each trace as elements, earliest first. ``events(by, *order, attrs)``.

    Each task cuts its rows to the limit first, so a long trace is no load.
    """
    back = F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order]))
    last = events.withColumn("back", back).where(F.col("back") <= limit)
    line = F.concat(F.lit("<event "), F.col("attrs"), F.lit("/>"))
    return last.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), line.alias("line")))), lambda x: x["line"]), "\n").alias("xml"))


def depths(edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """``(node, depth)``: the longest way from a root to each node of a DAG; more than ``limit`` levels are a cycle.

    One join of the frontier per level; each level is written, so that plans stay short.
    """
    level = keep(roots.select("node", F.lit(0).alias("depth")), "depth")
    found, steps = level, edges.select(F.col("parent"), F.col("child"))
    for d in range(1, limit + 2):
        level = keep(level.join(steps, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.lit(d).alias("depth")).distinct(), "depth")
        if level.isEmpty():
            break
        if d > limit:
            raise ValueError(f"a way of over {limit} steps: the graph has a cycle or is deeper")
        found = found.unionByName(level)
    return found.groupBy("node").agg(F.max("depth").alias("depth"))


def page_board(allowed: DataFrame, states: DataFrame, actions: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """Every page that is allowed or has a state: numbers of its nodes by state, the strongest state, actions, whether it is gold."""
    rank = F.when(F.col("state") == PRUNED, 3).when(F.col("state") == OPENED, 2).when(F.col("state") == ACTIVE, 1).otherwise(0)
    count = lambda s: F.count_if(F.col("state") == s)
    sums = states.groupBy(by, "page").agg(count(ACTIVE).alias("n_active"), count(OPENED).alias("n_opened"), count(PRUNED).alias("n_pruned"), F.max(F.struct(rank.alias("rank"), "state")).alias("top"))
    every = allowed.select(by, "page").unionByName(sums.select(by, "page")).distinct()
    done, marks = actions.groupBy(by, "page").agg(F.count("*").alias("n_actions")), gold.select(by, "page", F.lit(True).alias("gold"))
    joined = every.join(sums, [by, "page"], "left").join(done, [by, "page"], "left").join(marks, [by, "page"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(by, "page", *map(zero, ("n_active", "n_opened", "n_pruned")), F.coalesce("top.state", F.lit(INACTIVE)).alias("dominant"), zero("n_actions"), F.coalesce("gold", F.lit(False)).alias("is_evidence"))


def set_deltas(rows: DataFrame, before: str, after: str) -> DataFrame:
    """``rows`` with what a set gains and loses, sorted."""
    return rows.withColumns({"added": F.array_sort(F.array_except(after, before)), "removed": F.array_sort(F.array_except(before, after))})


def visible_edges(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """``edges`` of each snapshot ``nodes(by, id)``: those with both ends in it."""
    ends = edges.join(nodes.select(F.col(by), F.col("id").alias("one")), F.col("source") == F.col("one"))
    other = nodes.select(F.col(by).alias("of"), F.col("id").alias("two"))
    return ends.join(other, (F.col("target") == F.col("two")) & (F.col(by) == F.col("of")), "left_semi").drop("one")
