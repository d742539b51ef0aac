"""What a reader and an evaluator are shown: pages with their nodes and images in order, and the steps of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import escape_xml
from docquarry.operators.controller import ACTIVE, OPENED, PRUNED


def reader_layout(pages: DataFrame, nodes: DataFrame, by: str, page_images: bool = True, node_images: bool = True, crops: bool = True) -> DataFrame:
    """``(by, place, position, page_index, id, kind, ref, image_index)``: all that a reader gets, in its order.

    ``pages(by, page_index, pruned, step, source, has_image)`` has a row for each page, ``step`` (null: never) its first activation that went
    well; ``nodes(by, page_index, id, state, has_image, can_crop)`` the elements. Pages that the question names come first, then the other activated
    ones, each by step, then pages that hold active nodes, then opened ones, by the least such node id. A page is position 0; its opened nodes
    follow by id, then its active ones. Pruned pages and nodes don't show. Images are numbered in that order: a page's, a node's own, or
    else a crop of the page's image (``kind`` page, opened_node_image, opened_node_crop); without one kind and ref are null.

    Windows are by question, whose pages and nodes its document bounds.
    """
    live = pages.where(~F.coalesce("pruned", F.lit(False))).select(by, "page_index", "step", "source", F.coalesce("has_image", F.lit(False)).alias("page_image"))
    held = nodes.where(F.col("state").isin(ACTIVE, OPENED)).join(live.select(by, "page_index", "page_image"), [by, "page_index"])
    least = held.groupBy(by, "page_index").agg(F.min(F.struct((F.col("state") == OPENED).alias("opened"), "id")).alias("node"))
    walk = F.when(F.col("step").isNull(), 2).when(F.col("source") == "question_page_scope", 0).otherwise(1)
    order = Window.partitionBy(by).orderBy(walk, F.col("step").asc(), F.col("node.opened").asc(), F.col("node.id").asc(), "page_index")
    placed = live.join(least, [by, "page_index"], "left").where("step is not null or node is not null").withColumn("place", F.row_number().over(order))
    inside = Window.partitionBy(by, "page_index").orderBy((F.col("state") == ACTIVE).cast("int"), "id")
    own = F.when(F.coalesce("has_image", F.lit(False)), "opened_node_image")
    crop = F.when(F.lit(crops) & F.coalesce("can_crop", F.lit(False)) & F.col("page_image"), "opened_node_crop")
    kind = F.when(F.lit(node_images), F.coalesce(own, crop))
    shown = held.withColumn("position", F.row_number().over(inside)).join(placed.select(by, "page_index", "place"), [by, "page_index"])
    lines = placed.select(by, "place", F.lit(0).alias("position"), "page_index", F.lit(None).cast(nodes.schema["id"].dataType).alias("id"), F.when(F.lit(page_images) & F.col("page_image"), "page").alias("kind"))
    lines = lines.unionByName(shown.select(by, "place", "position", "page_index", "id", kind.alias("kind")))
    nth = F.count("kind").over(Window.partitionBy(by).orderBy("place", "position"))
    name = F.when(F.col("kind") == "page", "page_image_").when(F.col("kind").isNotNull(), "node_image_")
    return lines.withColumn("n", nth).select(by, "place", "position", "page_index", "id", "kind", F.concat(name, F.col("n").cast("string")).alias("ref"), F.when(F.col("kind").isNotNull(), F.col("n") - 1).cast("int").alias("image_index"))


#: The fields of a recorded step, as JSON has them.
_PAGE = "struct<page_index:int,score:string>"
_SELECTED = "array<struct<candidate_index:int,utility:string>>"
_PRUNED = "array<struct<node_id:string,reason:string>>"
TRACE_ITEM = (
    "struct<iteration:int,action:string,ok:boolean,message:string,node_id:string,query:string,candidate_index:int,original_count:int,executed_count:int,executed_total:int,limit:int,"
    "payload:struct<page_index:int,node_id:string,source:string,previous_state:string,reason:string,query:string>,"
    "selection:struct<candidate_index:int,candidate_id:string,resolved_candidate_id:string>,"
    f"decision:struct<stop:boolean,selected_actions:{_SELECTED},open_requests:array<struct<node_id:string>>,prune_requests:{_PRUNED},search_query:string>,"
    f"candidate_index_map:map<string,string>,activated_pages:array<int>,retrieved_pages:array<{_PAGE}>>"
)
_OF_NODE = ("ActivateNode", "OpenNode", "FinalOpenActiveNode", "FinalOpenActivePageNode")


def _cut(text: Column, limit: int = 240) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))


def _says(value: Column) -> Column:
    """A truth value as the words True and False."""
    return F.when(value, "True").otherwise("False")


def _attributes(**values: Column) -> Column:
    """Those that aren't null, in order, each after a blank."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f' {k.rstrip("_")}="'), escape_xml(v.cast("string"), True), F.lit('"')), F.lit("")) for k, v in values.items()])


def _lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def _block(name: str, rows: Column, line) -> Column:
    """An element over lines; ``line`` says what goes in one."""
    return F.concat_ws("\n", F.lit(f"      <{name}>"), F.transform(rows, lambda x: F.concat(F.lit("        "), line(x))), F.lit(f"      </{name}>"))


def _inline(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"      <{name}>"), escape_xml(_cut(text), True), F.lit(f"</{name}>"))


def trace_step(item: Column, page_node) -> Column:
    """A step of a trace as markup. ``item`` is a ``TRACE_ITEM``; ``page_node`` gives a page's node id for its index.

    Every kind of action has attributes of its own, and decisions, retrievals and prunings have a body; a message shows where no body does.
    """
    said, payload, chosen, decision = item["action"], item["payload"], item["selection"], item["decision"]
    none = lambda x: F.nullif(x, F.lit(""))
    some = lambda rows: F.when(F.size(rows) > 0, rows)
    count = lambda rows: F.coalesce(F.when(rows.isNotNull(), F.size(rows)), F.lit(0))
    page = payload["page_index"]
    target = F.coalesce(none(payload["node_id"]), item["node_id"])
    candidate = F.coalesce(none(chosen["resolved_candidate_id"]), chosen["candidate_id"])
    query = decision["search_query"]
    own = {
        ("ActivatePage",): _attributes(page_index=page, page_node=F.coalesce(none(payload["node_id"]), page_node(page)), source=payload["source"], previous_state=payload["previous_state"]),
        _OF_NODE: _attributes(target=target, previous_state=payload["previous_state"], selection=chosen["candidate_index"], candidate=candidate),
        ("PruneNode",): _attributes(target=payload["node_id"], previous_state=payload["previous_state"]),
        ("SearchEvidence",): _attributes(query=_cut(payload["query"])),
        ("SearchEvidenceRetrieval",): _attributes(query=_cut(item["query"])),
        ("EvaluatorDecision",): _attributes(
            stop=_says(decision["stop"]), selected_actions=count(decision["selected_actions"]), open_requests=count(decision["open_requests"]), prune_requests=count(decision["prune_requests"]), query=F.when(none(query).isNotNull(), _cut(query))
        ),
        ("TruncatedSelectedActions",): _attributes(original_count=item["original_count"], executed_count=item["executed_count"]),
        ("InvalidCandidate",): _attributes(candidate_index=item["candidate_index"]),
        ("SelectedActionBudgetReached",): _attributes(executed_total=item["executed_total"], limit=item["limit"]),
    }
    empty = lambda name, **values: F.concat(F.lit(f"<{name}"), _attributes(**values), F.lit("/>"))
    here = F.coalesce(item["activated_pages"], F.array().cast("array<int>"))
    found = F.coalesce(item["retrieved_pages"], F.array().cast(f"array<{_PAGE}>"))
    retrieved = _lines(
        _block("retrieved_pages", found, lambda p: empty("page", page_index=p["page_index"], page_node=page_node(p["page_index"]), score=p["score"], activated=_says(F.array_contains(here, p["page_index"])))),
        _block("activated_page_nodes", here, lambda i: empty("page", page_index=i, page_node=page_node(i))),
    )
    of = lambda x: F.try_element_at(item["candidate_index_map"], x["candidate_index"].cast("string"))
    pruned = lambda x: F.concat(F.lit('<node id="'), escape_xml(x["node_id"], True), F.lit('"><reason>'), escape_xml(_cut(x["reason"]), True), F.lit("</reason></node>"))
    told = _lines(
        F.when(F.size(decision["selected_actions"]) > 0, _block("selected_actions", some(decision["selected_actions"]), lambda x: empty("action", index=x["candidate_index"], candidate=of(x), utility=x["utility"]))),
        F.when(F.size(decision["open_requests"]) > 0, _block("open_requests", some(decision["open_requests"]), lambda x: empty("node", id=x["node_id"]))),
        F.when(none(query).isNotNull(), _inline("search_request", query)),
        F.when(F.size(decision["prune_requests"]) > 0, _block("prune_requests", some(decision["prune_requests"]), pruned)),
    )
    body = F.when(said == "PruneNode", F.when(none(payload["reason"]).isNotNull(), _inline("reason", payload["reason"]))).when(said == "SearchEvidenceRetrieval", retrieved).when(said == "EvaluatorDecision", none(told))
    body = F.coalesce(body, F.when(none(item["message"]).isNotNull(), _inline("message", item["message"])))
    extra = F.lit("")
    for kinds, attributes in own.items():
        extra = F.when(said.isin(*kinds), attributes).otherwise(extra)
    head = F.concat(F.lit("    <step"), _attributes(iteration=item["iteration"], action=F.coalesce(said, F.lit("")), ok=F.when(item["ok"].isNotNull(), _says(item["ok"]))), extra)
    return F.when(body.isNull(), F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">\n"), body, F.lit("\n    </step>")))


def recent_steps(trace: DataFrame, by: str, order: list[str], item: str, page_node, limit: int = 25) -> DataFrame:
    """``(by, xml)``: the last ``limit`` steps of each trace, earliest first. ``trace(by, *order, item)`` has steps as JSON text; what is
    no JSON shows as a step without action. Each task cuts its rows to the limit before they are shuffled."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order]))
    last = trace.withColumn("back", back).where(F.col("back") <= limit).withColumn("step", F.from_json(item, TRACE_ITEM))
    steps = last.select(by, F.struct((-F.col("back")).alias("at"), trace_step(F.col("step"), page_node).alias("line")).alias("s")).groupBy(by).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return steps.select(by, F.concat(F.lit("  <recent_trace>\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.lit("\n  </recent_trace>")).alias("xml"))
